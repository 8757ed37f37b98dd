"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A node's budget is dealt to its children by their weights. A child cannot use more than its tokens
times the most epochs; what it cannot use goes to its siblings, by weight, before it is reported to
the parent's level. Each leaf then takes whole epochs and a token-prefix of one more, in an order
that a seed fixes for every epoch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.llm.common import Scratch, text_of

LEVELS = ["domain", "lang", "source"]

BINS = 1 << 12
"""Ranges of the random order for which tokens are summed; only the one at the cut is ordered row by row."""


PIECE = 1 << 12
"""Copies of a row that are made at a time."""

MOST_LEAVES = 100_000
"""Leaves a tree may have: what the driver reads and the tasks are sent is one row for each."""


@dataclass
class Node:
    """A node of the tree: its capacity in tokens, and its children by name. A leaf has none."""

    capacity: float = 0.0
    children: dict = field(default_factory=dict)


def share(budget: float, capacities: list[float], weights: list[float]) -> list[float]:
    """Deal a budget by weight; what exceeds a capacity goes to the others by their weights.

    Children without weight get only what the weighted ones cannot use.
    """
    given = [0.0] * len(weights)
    for group in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w <= 0]):
        rest = budget - sum(given)
        openings = [i for i in group if capacities[i] > 0]
        while openings and rest > 1e-9:
            total = sum(max(weights[i], 0.0) for i in openings) or float(len(openings))
            parts = {i: rest * (weights[i] if weights[i] > 0 else 1.0) / total for i in openings}
            full = [i for i in openings if capacities[i] <= parts[i]]
            if not full:
                for i in openings:
                    given[i] = parts[i]
                break
            for i in full:
                given[i] = capacities[i]
                rest -= capacities[i]
            openings = [i for i in openings if i not in full]
    return given


def leaf_budgets(leaves: list[tuple[tuple, float]], budget: float, weights: dict[tuple, float], most_epochs: float) -> dict[tuple, float]:
    """Token budget of each leaf. ``leaves``: (path, tokens); ``weights`` by path prefix, 1 if not named."""
    root = Node()
    for path, tokens in leaves:
        node = root
        node.capacity += tokens * most_epochs
        for name in path:
            node = node.children.setdefault(name, Node())
            node.capacity += tokens * most_epochs
    out: dict[tuple, float] = {}

    def deal(node: Node, path: tuple, amount: float) -> None:
        if not node.children:
            out[path] = amount
            return
        names = sorted(node.children, key=lambda n: (n is not None, str(n)))
        parts = share(amount, [node.children[n].capacity for n in names], [weights.get((*path, n), 1.0) for n in names])
        for name, part in zip(names, parts):
            deal(node.children[name], (*path, name), part)

    deal(root, (), min(budget, root.capacity))
    return out


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch: a number below 2^60 that the seed, epoch and id fix."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def words_of(text: str = "text") -> Column:
    """Words of a text, as a stand-in for tokens: runs without white space."""
    return F.size(F.array_remove(F.split(text_of(text), r"\s+"), "")).cast("long")


def mix(
    docs: DataFrame,
    domain: Callable[[], Column],
    weights: dict[tuple, float],
    budget: float | None = None,
    most_epochs: int = 4,
    seed: int = 42,
    doc_id: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens): one row per copy of a document in the mixture.

    ``budget`` is in tokens, by default as many as the documents have. A leaf with budget B and T tokens
    takes floor(B / T) whole epochs and of the next one the longest prefix, in its seeded order, whose
    tokens do not exceed the rest. Ties of the order are broken by id.

    Leaves are counted, not collected: the driver holds one number per leaf of the tree. Prefix sums run
    over BINS ranges of the order first, so a leaf with a third of all rows is never ordered as a whole;
    only its bin at the cut is, one row per id and token count. Null lang or source form leaves of their own. Documents of no tokens
    belong to each epoch that is begun before the cut; a leaf of no tokens is left out, as is all of an
    empty table. Repeated rows are further documents. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), domain().alias("domain"), F.col("lang").alias("lang"), F.col("source").alias("source"), (words_of() if tokens is None else tokens).alias("n_tokens"))
    rows = scratch.cut(own)
    sums = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("total")).where("total > 0").limit(MOST_LEAVES + 1).collect()
    if len(sums) > MOST_LEAVES:
        raise ValueError(f"the tree has more than {MOST_LEAVES} leaves; name coarser sources")
    leaves = [(tuple(r[c] for c in LEVELS), float(r["total"])) for r in sums]
    if not leaves:
        return rows.select("doc_id", *LEVELS, F.lit(0).alias("epoch"), "n_tokens").limit(0)
    totals = dict(leaves)
    dealt = leaf_budgets(leaves, budget if budget is not None else sum(totals.values()), weights, most_epochs)
    plan = []
    for path, amount in dealt.items():
        total = int(totals[path])
        whole, rest = divmod(int(amount + 1e-6), total)
        if whole >= most_epochs:
            whole, rest = most_epochs, 0
        plan.append((*path, whole, rest))
    plan = docs.sparkSession.createDataFrame(plan, "p_domain string, p_lang string, p_source string, whole int, rest long")
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in LEVELS]
    planned = rows.join(F.broadcast(plan), same[0] & same[1] & same[2]).drop("p_domain", "p_lang", "p_source")  # one row per leaf
    names = ["doc_id", *LEVELS, "epoch", "n_tokens"]
    whole = planned.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*names)
    partial = planned.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("place", place(seed, F.col("whole"), F.col("doc_id")))
    partial = partial.withColumn("bin", F.shiftright("place", 60 - (BINS.bit_length() - 1)))
    bins = partial.groupBy(*LEVELS, "bin", "rest").agg(F.sum("n_tokens").alias("bin_tokens"))
    up_to = F.sum("bin_tokens").over(Window.partitionBy(*LEVELS).orderBy("bin"))  # at most BINS rows a leaf
    cut_at = bins.withColumn("before", up_to - F.col("bin_tokens")).where("before <= rest and before + bin_tokens > rest")
    cut_at = cut_at.select(*[F.col(c).alias(f"c_{c}") for c in LEVELS], F.col("bin").alias("cut"), "before")
    at_leaf = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in LEVELS]
    # One row per leaf, as many as the plan has.
    judged = partial.join(F.broadcast(cut_at), at_leaf[0] & at_leaf[1] & at_leaf[2], "left")
    below = judged.where("cut is null or bin < cut").select(*names)
    # Rows that agree in all that is returned are interchangeable. Counted first, however many share an id (or
    # have none), they are one row of the bin at the cut; of the group that crosses it as many stay as fit.
    alike = judged.where("bin = cut").groupBy(*names, "place", "rest", "before").agg(F.count("*").alias("copies"))
    through = F.sum(F.col("copies") * F.col("n_tokens")).over(Window.partitionBy(*LEVELS).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    room = alike.withColumn("room", F.col("rest") - F.col("before") - through + F.col("copies") * F.col("n_tokens")).where("room >= 0")
    fitting = F.when(F.col("n_tokens") == 0, F.col("copies")).otherwise(F.least(F.col("copies"), F.floor(F.col("room") / F.greatest("n_tokens", F.lit(1)))))
    counted = room.withColumn("fits", fitting.cast("long")).where("fits > 0")
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("fits") - 1) / PIECE))))
    last = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PIECE).cast("long"), F.col("fits") - F.col("piece") * PIECE)))).select(*names)
    return whole.unionByName(below).unionByName(last)
