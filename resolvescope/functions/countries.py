"""Country codes and names against an ISO 3166-1 table.

The table is a DataFrame (alpha2, alpha3, name, other_name). ``iso_table`` builds it from the JVM's
locale data and puts the standard's own names where they differ; any other table with those columns
can be passed to the jobs instead.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolvescope.functions.net import strip

# Fixed value: placeholder for an unknown country.
UNKNOWN = "***"


# Short names of ISO 3166-1 that differ from common English ones.
ISO_NAMES = {
    "AX": "Åland Islands", "BA": "Bosnia and Herzegovina", "BL": "Saint Barthélemy", "BN": "Brunei Darussalam", "BO": "Bolivia, Plurinational State of",
    "BQ": "Bonaire, Sint Eustatius and Saba", "CC": "Cocos (Keeling) Islands", "CD": "Congo, The Democratic Republic of the", "CG": "Congo",
    "CI": "Côte d'Ivoire", "CV": "Cabo Verde", "CW": "Curaçao", "CZ": "Czechia", "FK": "Falkland Islands (Malvinas)", "FM": "Micronesia, Federated States of",
    "GS": "South Georgia and the South Sandwich Islands", "HK": "Hong Kong", "HM": "Heard Island and McDonald Islands", "IR": "Iran, Islamic Republic of",
    "KN": "Saint Kitts and Nevis", "KP": "Korea, Democratic People's Republic of", "KR": "Korea, Republic of", "LA": "Lao People's Democratic Republic",
    "LC": "Saint Lucia", "MD": "Moldova, Republic of", "MF": "Saint Martin (French part)", "MK": "North Macedonia", "MM": "Myanmar", "MO": "Macao",
    "PM": "Saint Pierre and Miquelon", "PN": "Pitcairn", "PS": "Palestine, State of", "RE": "Réunion", "RU": "Russian Federation",
    "SH": "Saint Helena, Ascension and Tristan da Cunha", "SJ": "Svalbard and Jan Mayen", "ST": "Sao Tome and Principe", "SX": "Sint Maarten (Dutch part)",
    "SY": "Syrian Arab Republic", "SZ": "Eswatini", "TC": "Turks and Caicos Islands", "TL": "Timor-Leste", "TR": "Türkiye", "TT": "Trinidad and Tobago",
    "TW": "Taiwan, Province of China", "TZ": "Tanzania, United Republic of", "UM": "United States Minor Outlying Islands", "VA": "Holy See (Vatican City State)",
    "VC": "Saint Vincent and the Grenadines", "VE": "Venezuela, Bolivarian Republic of", "VG": "Virgin Islands, British", "VI": "Virgin Islands, U.S.",
    "VN": "Viet Nam", "WF": "Wallis and Futuna", "AG": "Antigua and Barbuda",
}


@lru_cache(maxsize=4)
def _locale_rows(jvm) -> list[tuple[str, str, str, str]]:
    locale = jvm.java.util.Locale
    rows = []
    for code in locale.getISOCountries():
        place = locale("", code)
        common = place.getDisplayCountry(locale.ENGLISH)
        rows.append((code, place.getISO3Country(), ISO_NAMES.get(code, common), common))
    return rows


def iso_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_locale_rows(spark.sparkContext._jvm), "alpha2 string, alpha3 string, name string, other_name string")


def _lookup(iso: DataFrame) -> DataFrame:
    names = ["name"] + (["other_name"] if "other_name" in iso.columns else [])
    keys = F.explode(F.array_distinct(F.array("alpha2", "alpha3", *[F.upper(n) for n in names])))
    return iso.select(keys.alias("_key"), F.col("alpha3").alias("_alpha3"), F.col("name").alias("_name")).dropDuplicates(["_key"])


def clean_country(df: DataFrame, col: str, iso: DataFrame, out: str | None = None) -> DataFrame:
    """Alpha-2, alpha-3 or English name to alpha-3; unknown text is kept upper-case."""
    text = F.upper(strip(F.col(col)))
    key = F.when((text != "") & (text != UNKNOWN), text)
    joined = df.withColumn("_key", key).join(_lookup(iso), "_key", "left")
    return joined.withColumn(out or col, F.coalesce("_alpha3", "_key")).drop("_key", "_alpha3", "_name")


def query_country(df: DataFrame, col: str, iso: DataFrame, out: str | None = None) -> DataFrame:
    """Query-parameter form: only known alpha-2 and alpha-3 codes, everything else null."""
    codes = iso.select(F.explode(F.array("alpha2", "alpha3")).alias("_key"), F.col("alpha3").alias("_alpha3"))
    joined = df.withColumn("_key", F.upper(strip(F.col(col)))).join(codes, "_key", "left")
    return joined.withColumn(out or col, F.col("_alpha3")).drop("_key", "_alpha3")


def short_name(name: Column) -> Column:
    """Display name: the part before a comma, without parentheses, single-spaced."""
    bare = F.regexp_replace(F.substring_index(name, ",", 1), r"\s*\([^)]*\)", "")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def country_display_name(df: DataFrame, col: str, iso: DataFrame, out: str = "country_name") -> DataFrame:
    """Code or name to a display name; unknown text is shown as it is."""
    joined = df.withColumn("_key", F.upper(strip(F.col(col)))).join(_lookup(iso), "_key", "left")
    shown = F.coalesce(short_name(F.col("_name")), short_name(strip(F.col(col))))
    return joined.withColumn(out, shown).drop("_key", "_alpha3", "_name")
