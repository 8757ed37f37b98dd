"""Clean-up of lookup tables: what users ask for, per kind, with the bad ones flagged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.functions.clean import clean_domain, is_fqdn, query_asn, split_service
from resolvescope.functions.countries import query_country
from resolvescope.functions.net import strip, with_ip_key, with_prefix_key

KINDS = ("ip", "prefix", "asn", "country", "domain", "service")


def clean_targets(asked: DataFrame, kind: str, iso: DataFrame | None = None, v6: bool = True) -> DataFrame:
    """``asked`` (column target, text) with ``value``, the form that reports match, and ``valid``.

    Prefixes may be URL-encoded (``192.0.2.0%2F24``) and have host bits; networks may be written
    ``AS64496``; countries are two- or three-letter codes; services are ``protocol`` or
    ``protocol:port``, whose value is the same text in lower case. Bad and null targets are kept, with a
    null value.
    """
    if kind not in KINDS:
        raise ValueError(f"no such kind of target: {kind}; use {', '.join(KINDS)}")
    if kind == "ip":
        out = with_ip_key(asked, "target", out="value", v6=v6)
    elif kind == "prefix":
        out = with_prefix_key(asked.withColumn("_asked", F.coalesce(F.try_url_decode(F.replace(strip(F.col("target")), F.lit("+"), F.lit("%2B"))), "target")), "_asked", out="value", v6=v6)
    elif kind == "asn":
        out = asked.withColumn("value", query_asn(F.col("target")).cast("string"))
    elif kind == "country":
        if iso is None:
            raise ValueError("country targets need an ISO table")
        out = query_country(asked, "target", iso, out="value")
    elif kind == "domain":
        out = asked.withColumn("value", F.when(is_fqdn(F.col("target")), clean_domain(F.col("target"))))
    else:
        service = split_service(F.col("target"))
        out = asked.withColumn("value", F.when(service["protocol"].isNotNull(), F.concat_ws(":", service["protocol"], service["port"].cast("string"))))
    return out.select(*asked.columns, "value", F.col("value").isNotNull().alias("valid"))
