"""How quality filters interact: every order of applying them, from one potential per set of filters.

Removal is a game: the worth v(S) of a set S of filters is the number of documents that at least one of
them fails. Its Hart-Mas-Colell potential follows from the potentials of the sets with one filter less,
P(S) = (v(S) + sum of P(S without i)) / |S|, and a filter's Shapley value is P(all) - P(all without it).
What a filter removes at some step of an order is the difference of two worths. So the corpus is read
once, down to a count per part and set of failed filters; everything else works on 2^k numbers per part.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.llm.common import let, split_words, text_of

SPACE = r"[\x20\x09-\x0D]"

FEWEST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 3
MARKUP = r"[#$%&*|]"


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D of a text, as booleans: too short, too repetitive, too many capitals, markup signs."""
    counts = let(split_words(text, SPACE), lambda words: F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("distinct")))
    letters = F.length(text)
    upper = letters - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        counts["words"] < FEWEST_WORDS,
        counts["distinct"].cast("long") * 100 < counts["words"].cast("long") * LEAST_DISTINCT_PERCENT,
        upper.cast("long") * 100 > letters.cast("long") * MOST_UPPER_PERCENT,
        text.rlike(MARKUP),
    ]


def as_bits(conditions: list[Column]) -> Column:
    """The set of true conditions as a number, the first one its lowest bit."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, failed, n, good, toxic): rows per part and set of failed filters A to E (bits 0 to 4), and
    how many of them ``labels`` marks with quality 1 and with toxic 1.

    E fails a row whose text stands under a smaller doc_id anywhere in the table. Texts are compared by
    128 bits of hash and never shuffled. Rows are counted per (text, part, marks, doc_id) before they
    meet by text, so a text that a third of all rows share arrives as a row per part and marks.
    A null text counts as empty, a null part as ''. A row with a null doc_id neither fails E nor makes
    others fail it, and has no marks. Rows that repeat doc_id and text all count and do not fail E through
    each other. Where ``labels`` repeats a doc_id, one mark of 1 is enough. Other columns are not read.
    """
    whole = text_of(text)
    read = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.xxhash64(whole).alias("key"), F.xxhash64(F.lit(1), whole).alias("key2"), as_bits(text_failures(whole)).alias("failed"))
    once = read.groupBy("key", "key2", "failed", "part", "id").agg(F.count("*").alias("n"))

    marks = labels.select(F.col("doc_id").alias("marked"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("marked is not null")
    marks = marks.groupBy("marked").agg(F.coalesce(F.max("q"), F.lit(False)).alias("q"), F.coalesce(F.max("t"), F.lit(False)).alias("t")).where("q or t")
    # Rows without an id go by their text, so they do not meet under null.
    dealt = once.withColumn("dealt", F.coalesce(F.col("id"), F.col("key")))
    joined = dealt.join(marks, (dealt["dealt"] == marks["marked"]) & dealt["id"].isNotNull(), "left")
    rows = joined.select("key", "key2", "failed", "part", "id", F.coalesce("q", F.lit(False)).alias("good"), F.coalesce("t", F.lit(False)).alias("toxic"), "n")

    own = ["key", "key2", "failed", "part", "good", "toxic"]
    variants = rows.groupBy(*own, F.col("id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    smallest = F.min(F.when(~F.col("nameless"), F.col("first.id"))).over(Window.partitionBy("key", "key2"))
    passing = F.when(F.col("nameless"), F.col("n")).when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = variants.withColumn("smallest", smallest).select("part", "failed", "good", "toxic", "n", passing.alias("passing"))
    sides = F.explode(F.array(F.struct(F.col("failed"), F.col("passing").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("passing")).alias("n"))))
    cells = split.select("part", "good", "toxic", sides.alias("side")).select("part", "good", "toxic", "side.*").where("n > 0")
    ones = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(mark)
    return cells.groupBy("part", "failed").agg(F.sum("n").alias("n"), ones("good"), ones("toxic"))


def worths(counts: DataFrame, filters: int) -> DataFrame:
    """(part, total, worth, good, toxic): arrays over all sets S of filters, indexed by their bits, of the
    rows (marked rows) that fail a filter of S."""
    sets = 1 << filters
    wide = counts.select("part", "failed", "n", "good", "toxic", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    hit = F.col("failed").bitwiseAND(F.col("set")) != 0
    caught = lambda name: F.sum(F.when(hit, F.col(name)).otherwise(0)).alias(name)
    worth = wide.groupBy("part", "set").agg(F.sum("n").alias("total"), caught("n"), caught("good"), caught("toxic"))
    ordered = F.array_sort(F.collect_list(F.struct("set", "n", "good", "toxic")))  # one entry per set of filters
    listed = worth.groupBy("part").agg(F.max("total").alias("total"), ordered.alias("sets"))
    return listed.select("part", "total", F.col("sets.n").alias("worth"), F.col("sets.good").alias("good"), F.col("sets.toxic").alias("toxic"))


def scale(filters: int) -> int:
    """Potentials are fractions with denominators 1 to ``filters``; times this they are whole numbers."""
    return math.lcm(*range(1, filters + 1))


def potentials(worth: Column, filters: int) -> Column:
    """Potentials of all sets, times ``scale``, from the array of their worths: each from the sets with one filter less."""

    def of_set(known: Column, s: Column) -> Column:
        without = sum((F.when(s.bitwiseAND(1 << i) != 0, F.get(known, s.bitwiseXOR(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(filters)), F.lit(0).cast("long"))
        return F.call_function("div", F.get(worth, s) * scale(filters) + without, F.bit_count(s))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), lambda known, s: F.concat(known, F.array(of_set(known, s))))


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step, from ``failure_counts``: what is kept after the step,
    what its filter removes there (in all, good, toxic), what it fails that was gone before, what only it
    fails, and its removals summed over all orders (the Shapley value times the number of orders).

    Zeros are rows too; without counts there are no rows.
    """
    k = len(letters)
    every = (1 << k) - 1
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(letters)])
    bits = lambda name: as_bits([name.contains(letter) for letter in letters])
    games = worths(counts, k)
    games = games.withColumn("potential", potentials(F.col("worth"), k))
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    named = steps.withColumns({
        "before": bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1)), "after": bits(F.col("filter_order").substr(F.lit(1), F.col("step")))})
    own = F.col("after") - F.col("before")
    gain = lambda name: F.get(name, F.col("after")) - F.get(name, F.col("before"))
    others = F.lit(every) - own
    return named.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("total") - F.get("worth", F.col("after"))).alias("kept"),
        gain("worth").alias("removed"),
        (F.get("worth", own) - gain("worth")).alias("redundant"),
        (F.get("worth", F.lit(every)) - F.get("worth", others)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        ((F.get("potential", F.lit(every)) - F.get("potential", others)) * (math.factorial(k) // scale(k))).alias("shapley"))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the filters A to E over whole ``docs``, per language."""
    return audit(failure_counts(docs, labels), "ABCDE")
