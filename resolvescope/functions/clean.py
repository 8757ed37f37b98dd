"""Column-cleaning expressions. All are native columns and stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolvescope.functions.net import strip

# Vocabularies of the feeds.
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")
PROTOCOL_NAMES = {
    "h3": "doh3",
    "h2": "doh",
    "http2": "doh",
    "http/2": "doh",
    "http/1.1": "doh1.1",
    "tcp": "dotcp",
    "udp": "doudp",
}
QMIN_CODES = {"0": "no", "1": "yes", "2": "unstable"}
FORWARDER_TYPES = {
    "transparent": "transparent",
    "transparent forwarder": "transparent",
    "recursive": "recursive",
    "forwarder": "recursive",
}
MAX_ASN = 4294967295
DNS_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
PROTOCOL_PATTERN = r"^[a-z0-9][a-z0-9.+-]*$"


def _rename(col: Column, names: dict[str, str]) -> Column:
    """Vocabulary lookup; words outside it are kept."""
    out = F.when(F.lit(False), col)
    for word, name in names.items():
        out = out.when(col == word, name)
    return out.otherwise(col)


def _integer(text: Column) -> Column:
    """Text of a plain integer to BIGINT, anything else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def clean_text(col: Column) -> Column:
    """Trim; empty becomes null."""
    return F.nullif(strip(col), F.lit(""))


def clean_bool(col: Column, default: bool = False, numeric: bool = False) -> Column:
    """Boolean words with a default; ``numeric`` makes any non-zero number true."""
    text = F.lower(strip(col))
    out = F.when(text.isin(*TRUE_WORDS), True).when(text.isin(*FALSE_WORDS), False)
    if numeric:
        number = text.try_cast("double")
        out = out.when(number.isNotNull(), number != 0)
    return out.otherwise(F.lit(default))


def clean_ts(col: Column, default: Column | None = None) -> Column:
    """ISO text, naive text (UTC) or bare date to a timestamp; unreadable becomes null or ``default``."""
    text = strip(col)
    shaped = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}.*)?$"), text)
    parsed = shaped.try_cast("timestamp")
    return parsed if default is None else F.coalesce(parsed, default)


def import_day(now: Column | None = None) -> Column:
    """Midnight UTC of the import, the default stamp of resolver and QNAME-minimisation feeds."""
    return F.date_trunc("DAY", F.current_timestamp() if now is None else now)


def clean_asn(col: Column, low: int | None = None, high: int | None = None, strip_prefix: bool = False) -> Column:
    """AS number; optional range and optional ``AS`` prefix (the query-parameter form)."""
    text = strip(col)
    if strip_prefix:
        text = F.regexp_replace(F.upper(text), r"^AS\s*", "")
        text = F.when(text.rlike(r"^[0-9]+$"), text)
    number = _integer(text)
    if low is not None:
        number = F.when(number.between(low, MAX_ASN if high is None else high), number)
    return number


def census_asn(col: Column) -> Column:
    return clean_asn(col, 0, MAX_ASN)


def query_asn(col: Column) -> Column:
    return clean_asn(col, 1, MAX_ASN, strip_prefix=True)


def explode_asns(df: DataFrame, col: str, out: str = "asn") -> DataFrame:
    """One row per origin of a multi-origin text such as ``1_2_-``; ``-`` and bad parts are null."""
    parts = F.explode_outer(F.split(F.col(col).cast("string"), "_"))
    return df.withColumn("_part", parts).withColumn(out, census_asn(F.nullif(F.col("_part"), F.lit("-")))).drop("_part")


def clean_port(col: Column) -> Column:
    number = _integer(strip(col))
    return F.when(number.between(1, 65535), number.cast("int"))


def clean_count(col: Column) -> Column:
    """Non-negative count."""
    number = _integer(strip(col))
    return F.when(number >= 0, number)


def clean_int(col: Column) -> Column:
    """Integer read through a float, ``"3.0"`` is 3; fractions are cut towards zero."""
    number = strip(col).try_cast("double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return whole.cast("bigint")


def clean_qmin(col: Column) -> Column:
    text = F.lower(clean_text(col))
    return _rename(F.regexp_replace(text, r"\.0$", ""), QMIN_CODES)


def clean_forwarder_type(col: Column) -> Column:
    return F.coalesce(_rename(F.lower(clean_text(col)), FORWARDER_TYPES), F.lit("recursive"))


def clean_protocol(col: Column) -> Column:
    """Protocol or ALPN name to the service vocabulary; other names lower-case."""
    return _rename(F.lower(strip(col)), PROTOCOL_NAMES)


def explode_protocols(df: DataFrame, col: str = "protocol", rename: bool = True) -> DataFrame:
    """Comma text to one row per non-empty protocol. Forwarder feeds keep plain lower-case names."""
    parts = F.explode(F.split(F.col(col), ","))
    name = clean_protocol if rename else (lambda c: F.lower(strip(c)))
    return df.withColumn("_part", parts).withColumn(col, name(F.col("_part"))).drop("_part").where(F.col(col) != "")


def clean_list(col: Column) -> Column:
    """``a,b`` or ``['a','b']`` text to an array of trimmed, non-empty items; null gives an empty array."""
    text = F.regexp_replace(strip(col), r"^\[(.*)\]$", "$1")
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.btrim(strip(x), F.lit("'\"")))
    return F.filter(items, lambda x: x != "")


def clean_items(col: Column) -> Column:
    """Array column to trimmed non-empty items."""
    items = F.transform(F.coalesce(col, F.array().cast("array<string>")), strip)
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def array_to_text(col: Column) -> Column:
    """Array to comma text without nulls."""
    return F.array_join(col, ",")


def clean_domain(col: Column) -> Column:
    """Trim, drop trailing dots, lower; empty becomes null."""
    return F.nullif(F.lower(F.rtrim(strip(col), F.lit("."))), F.lit(""))


def is_fqdn(col: Column) -> Column:
    name = F.lower(F.rtrim(strip(col), F.lit(".")))
    return (F.length(name) <= 253) & name.rlike(rf"^{DNS_LABEL}(?:\.{DNS_LABEL})+$")


def split_service(col: Column) -> Column:
    """``proto`` or ``proto:port`` to struct(protocol, port, valid)."""
    text = F.lower(strip(col))
    has_port = text.contains(":")
    protocol = F.when(has_port, F.regexp_extract(text, r"^(.*):[^:]*$", 1)).otherwise(text)
    port_text = F.when(has_port, F.regexp_extract(text, r":([^:]*)$", 1))
    port = clean_port(F.when(port_text.rlike(r"^[0-9]+$"), port_text))
    valid = protocol.rlike(PROTOCOL_PATTERN) & (~has_port | port.isNotNull())
    return F.struct(
        F.when(valid, protocol).alias("protocol"),
        F.when(valid, port).alias("port"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def endpoint_ip(col: Column) -> Column:
    """Address text of ``[v6]:port``, ``v4:port`` or a bare address; other text is kept.

    The canonical form is left to the address key, which runs next in every job.
    """
    text = strip(col)
    bracketed = F.regexp_extract(text, r"^\[([^\]]*)\]", 1)
    host = F.regexp_extract(text, r"^(.*):[0-9]+$", 1)
    single_colon = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit(""))) == 1
    out = (
        F.when(text == "", None)
        .when(text.rlike(r"^\[[^\]]*\]"), bracketed)
        .when(single_colon & text.rlike(r":[0-9]+$"), host)
        .otherwise(text)
    )
    return out


def org_short(col: Column, hyphenated: bool = False) -> Column:
    """First word of an organisation name."""
    pattern = r"^([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)" if hyphenated else r"^([A-Za-z0-9]+)"
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def protocol_tokens(col: Column) -> Column:
    """Distinct letter runs of a protocol text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("([a-z]+)"), 1))


def supports(col: Column, token: str) -> Column:
    return F.array_contains(protocol_tokens(col), token)


def pc(part: Column, whole: Column) -> Column:
    """Percent with two digits, 0 for an empty whole."""
    share = F.round(part.cast("double") * 100 / F.nullif(whole.cast("double"), F.lit(0.0)), 2)
    return F.coalesce(share, F.lit(0.0))


def spoof_state(private: Column, routed: Column) -> dict[str, Column]:
    """Flags of one spoofing observation: allow, received, blocked, unknown."""
    p = F.lower(F.coalesce(private, F.lit("")))
    r = F.lower(F.coalesce(routed, F.lit("")))
    allow = p.isin("received", "rewritten") | r.isin("received", "rewritten")
    closed = (p == "blocked") | (r == "blocked")
    return {
        "allow": allow,
        "received": (p == "received") | (r == "received"),
        "blocked": ~allow & closed,
        "unknown": ~allow & ~closed,
    }


# One text for several values, as rows of many small columns take far more room between tasks. A piece is empty for null, else
# begins with a mark; both signs below are escaped, so any text comes back as it was.
APART, ESCAPE, PLAIN = "\x01", "\x02", "="


def pack(pieces: list[Column]) -> Column:
    """Texts made by ``piece``, or null, as one text."""
    return F.concat_ws(APART, *[F.coalesce(p, F.lit("")) for p in pieces])


def piece(value: Column) -> Column:
    """A value as a piece of a packed text."""
    safe = F.replace(F.replace(value.cast("string"), F.lit(ESCAPE), F.lit(ESCAPE + "\x03")), F.lit(APART), F.lit(ESCAPE + "\x04"))
    return F.concat(F.lit(PLAIN), safe)


def unpacked(packed: Column, at: int) -> Column:
    """The piece at a position, null where it was null."""
    return F.nullif(F.get(F.split(packed, APART), F.lit(at)), F.lit(""))


def value_of(found: Column) -> Column:
    """The text of a piece."""
    safe = F.substring(found, 2, 1 << 30)
    return F.replace(F.replace(safe, F.lit(ESCAPE + "\x04"), F.lit(APART)), F.lit(ESCAPE + "\x03"), F.lit(ESCAPE))
