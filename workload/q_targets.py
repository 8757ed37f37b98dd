"""Clean-up of asked targets, one query per kind, with good and bad forms over all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from resolvescope.functions.countries import iso_table
from resolvescope.plans.targets import clean_targets
from workload.q_rest import sql_pick
from workload.registry import query

# Per kind: target -> value.
FORMS = {
    "ip": {" 192.0.2.1 ": "192.0.2.1", "2001:DB8::1": "2001:db8::1", "192.0.2.256": None, "": None, "host": None},
    "prefix": {"192.0.2.7%2F24": "192.0.2.0/24", "192.0.2.1": "192.0.2.1/32", "2001:db8::%2F32": "2001:db8::/32", "192.0.2.0/33": None, "%": None},
    "asn": {"AS64496": "64496", " as 4200000000": "4200000000", "0": None, "4294967296": None, "ASX": None},
    "country": {"de": "DEU", " fra ": "FRA", "XX": None, "Germany": None, "": None},
    "domain": {"Dns.Example.COM.": "dns.example.com", "localhost": None, "a..b": None, "x_y.example": None, "a-1.example": "a-1.example"},
    "service": {"DoT:853": "dot:853", "doh": "doh", "dot:0": None, "dot:x": None, ":53": None},
}

for _kind, _forms in FORMS.items():

    @query(f"c27_clean_targets_{_kind}", f"SELECT o_orderkey AS k, v AS value, v IS NOT NULL AS valid FROM (SELECT o_orderkey, {sql_pick('o_orderkey%5', *_forms.values())} AS v FROM orders)")
    def _(t, kind=_kind, forms=_forms):
        text = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("o_orderkey") % 5 + 1).cast("int"))
        asked = t.raw("orders").select(F.col("o_orderkey").alias("k"), text.alias("target"))
        return clean_targets(asked, kind, iso_table(t.spark)).drop("target")
