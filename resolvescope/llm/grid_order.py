"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is at least t lie within eps = sqrt(2 - 2t) of one another. The vectors are
turned onto their principal axes, cut into grid cells of width eps on the leading ones and sorted by
space (label and length) and cell: a sequence in which close vectors tend to stand close together. The
sequence is dealt into blocks. Intervals of blocks, from the whole sequence downwards, are joined with
one another, and a pair whose bounding boxes lie more than eps apart is dropped with all it contains.
What is left are pairs of blocks; each is joined in one task by halving both blocks in the same manner
down to small tiles, whose cosines are one matrix product.

A task returns, per vector, how many links it found and one edge of a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.llm.common import Scratch, components, lists_of, small_batches

THRESHOLD = 0.93
GRID = 8
"""Principal axes that are cut into cells."""
AXES = 32
"""Principal axes that boxes are kept for."""
BLOCK_BYTES = 1 << 18
"""Size of a block's vectors, about: the unit that is shuffled."""
MOST_ROWS = 1 << 11
"""Vectors of a block at most."""
TASK_BLOCKS = 16
"""Blocks that one sorting task cuts, about."""
TILE = 128
FAN = 16
"""Intervals of one level that make one of the next."""
SLACK = 1e-9
"""Boxes and matrix products carry rounding errors; what lies closer to the border is looked at exactly."""
MOST_HOT = 1 << 12
"""Vectors with more copies than a 1/4096 of all rows: at most this many, so their results are broadcast."""


def marked_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str | None) -> DataFrame:
    """(vec_id, space, vector, key, key2) of every row; vector is null where the row cannot link."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(embedding)
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    if label is not None:
        usable = usable & F.col(label).isNotNull()
    space = F.concat_ws("/", F.col(label).cast("string") if label is not None else F.lit(""), F.size(v).cast("string"))
    plus = F.transform(v, lambda x: x + F.lit(0).cast(_element(vectors, embedding)))  # -0.0 is 0.0
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(usable, space).alias("space"), F.when(usable, plus).alias("vector"))
    return rows.withColumns({"key": F.xxhash64("space", "vector"), "key2": F.xxhash64(F.lit(1), "space", "vector")})


def _element(vectors: DataFrame, embedding: str) -> str:
    return vectors.schema[embedding].dataType.elementType.simpleString()


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(key, key2, space, vector, least, members): one row per distinct vector of a space.

    Named by 128 bits of hash; a map-side count, so a vector that a third of all rows share is no hot key.
    """
    found = rows.where("vector is not null").groupBy("key", "key2").agg(
        F.first("space").alias("space"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("members"))
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, scaled down before squaring."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrices(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in a batch."""
    values, ends = lists_of(batch.column(column))
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, values[ends[at][:, None] + np.arange(size)]


def principal_axes(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(width, axes): the leading principal axes (as columns) of the unit vectors of the commonest length.

    The moments are summed over all vectors: a task adds up its own, one row per dimension leaves it.
    The driver gets width^2 numbers. Vectors of other lengths use their first coordinates as axes, which
    costs pruning only: any orthonormal axes keep the result right.
    """
    common = nodes.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return 0, np.zeros((0, 0))
    width = common["width"]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in _matrices(batch):
                if x.shape[1] == width:
                    x = unit(x)
                    total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], names=["i", "sums"])

    parts = nodes.select("vector").mapInArrow(moments, "i int, sums array<double>")
    cells = parts.select("i", F.posexplode("sums").alias("j", "part")).groupBy("i", "j").agg(F.sum("part").alias("s")).toPandas()
    total = np.zeros((width, width))
    total[cells["i"], cells["j"]] = cells["s"]
    _, axes = np.linalg.eigh((total + total.T) / 2)
    return width, np.ascontiguousarray(axes[:, ::-1][:, :AXES])


def on_axes(x: np.ndarray, width: int, axes: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors on AXES axes; vectors of another length, or short ones, are filled with zeros."""
    if x.shape[1] == width:
        x = x @ axes
    y = np.zeros((len(x), AXES))
    y[:, :min(AXES, x.shape[1])] = x[:, :AXES]
    return y


def blocks_of(scratch: Scratch, nodes: DataFrame, n: int, eps: float, fitted: tuple[int, np.ndarray]) -> DataFrame:
    """(block, space, low, high, key, key2, members, least, vectors): the sorted sequence in blocks of one space each.

    ``block`` numbers them in order; low and high bound their coordinates on AXES axes. Equal cells are ordered by hash, so even a cell of a third of all
    vectors is dealt over tasks.
    """
    width, axes = fitted
    kind = nodes.schema["vector"].dataType.elementType.simpleString()
    size = 4 if kind == "float" else 8
    most = int(min(MOST_ROWS, max(TILE, BLOCK_BYTES // (size * max(1, width)))))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, GRID), dtype=np.int32)
            for at, x in _matrices(batch):
                cells[at] = np.floor(on_axes(unit(x), width, axes)[:, :GRID] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])

    order = ["space", "cell", "key", "key2"]
    placed = nodes.select("key", "key2", "space", "vector", "members", "least").mapInArrow(celled, f"key long, key2 long, space string, vector array<{kind}>, members long, least long, cell array<int>")
    tasks = max(1, math.ceil(n / (TASK_BLOCKS * most)))
    # Cut before the sort: the ranges are drawn from a sample, and a retried sort must see the same rows.
    dealt = scratch.cut(placed).repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        place, part, space = 0, 0, None

        def full() -> pa.RecordBatch:
            nonlocal place
            rows = np.stack([h[2] for h in held])
            y = on_axes(unit(rows), width, axes)
            made = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([space]), pa.array([y.min(axis=0)]), pa.array([y.max(axis=0)]),
                pa.array([[h[0] for h in held]], pa.list_(pa.int64())), pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([[h[3] for h in held]], pa.list_(pa.int64())),
                pa.array([[h[4] for h in held]], pa.list_(pa.int64())), pa.array([rows.ravel()])], names=["part", "place", "space", "low", "high", "key", "key2", "members", "least", "vectors"])
            held.clear()
            place += 1
            return made

        for batch in batches:
            values, ends = lists_of(batch.column("vector"))
            columns = [batch.column(c).to_pylist() for c in ("key", "key2", "members", "least", "space", "part")]
            for i, (key, key2, members, least, own, task) in enumerate(zip(*columns)):
                if held and (own != space or len(held) >= most):
                    yield full()
                space, part = own, task
                held.append((key, key2, values[ends[i]:ends[i + 1]], members, least))
        if held:
            yield full()

    schema = f"part int, place long, space string, low array<double>, high array<double>, key array<long>, key2 array<long>, members array<long>, least array<long>, vectors array<{kind}>"
    cut = scratch.cut(dealt.select("key", "key2", "vector", "members", "least", "space", "part").mapInArrow(blocked, schema))
    # One row per sorting task reaches the driver: where its blocks begin in the sequence.
    sizes = sorted((r["part"], r["n"]) for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect())
    begins, so_far = [], 0
    for part, blocks in sizes:
        begins.append((part, so_far))
        so_far += blocks
    starts = scratch.spark.createDataFrame(begins, "part int, begin long")
    return cut.join(F.broadcast(starts), "part").withColumn("block", F.col("begin") + F.col("place")).drop("part", "place", "begin")


def apart(eps: float) -> Column:
    """Whether the boxes of two intervals (structs x and y) lie provably further than eps apart, or in other spaces."""
    gap = lambda a, b: F.greatest(a - b, F.lit(0.0))
    over = F.zip_with("x.low", "y.high", gap)
    under = F.zip_with("y.low", "x.high", gap)
    squares = F.aggregate(F.zip_with(over, under, lambda a, b: a * a + b * b), F.lit(0.0), lambda s, g: s + g)
    return (F.col("x.last") < F.col("y.first")) | (F.col("y.last") < F.col("x.first")) | (squares > (eps + SLACK) ** 2)


def close_pairs(scratch: Scratch, blocks: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """(a, b), a <= b: blocks not provably apart, found by joining intervals of the sequence downwards.

    Level by level, an interval pair is replaced by the pairs of their FAN parts; every join is on an
    interval's number.
    """
    boxes = [scratch.cut(blocks.select("block", F.col("space").alias("first"), F.col("space").alias("last"), "low", "high"))]
    while n_blocks > 1:
        n_blocks = math.ceil(n_blocks / FAN)
        wide = boxes[-1].groupBy(F.floor(F.col("block") / FAN).alias("block")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"),
            F.array(*[F.min(F.get("low", F.lit(i))) for i in range(AXES)]).alias("low"), F.array(*[F.max(F.get("high", F.lit(i))) for i in range(AXES)]).alias("high"))
        boxes.append(scratch.cut(wide))
    pairs = boxes[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    for level in reversed(boxes[:-1]):
        parts = lambda side: F.explode(F.sequence(F.col(side) * FAN, F.col(side) * FAN + FAN - 1))
        box = lambda name: level.select(F.col("block").alias(name), F.struct("first", "last", "low", "high").alias(name + "_box"))
        left = pairs.withColumn("x_at", parts("a")).join(box("x_at"), "x_at")
        both = left.withColumn("y_at", parts("b")).where("x_at <= y_at").join(box("y_at"), "y_at")
        named = both.select("x_at", "y_at", F.col("x_at_box").alias("x"), F.col("y_at_box").alias("y"))
        pairs = scratch.cut(named.where(~apart(eps)).select(F.col("x_at").alias("a"), F.col("y_at").alias("b")))
    return pairs


class Forest:
    """Union-find over the rows of two blocks."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors with correctly rounded sums, so that it depends on nothing but them."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def products(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u @ v.T


def joined(x: np.ndarray, y: np.ndarray, weight_x: np.ndarray, weight_y: np.ndarray, same: bool, axes: tuple[int, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Links between the rows of two blocks (of one block with itself): per row the weight it is linked
    to, and the forest of what hangs together; rows of y follow those of x.

    Both sequences are halved recursively; parts whose boxes lie more than eps apart are skipped.
    """
    eps2 = (math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK) ** 2
    u, v = unit(x), unit(y)
    p, q = on_axes(u, *axes), on_axes(v, *axes)
    n_x, n_y = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    forest = Forest(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:  # the mirror image of another part
            continue
        gaps = np.maximum(0, np.maximum(p[a:b].min(axis=0) - q[c:d].max(axis=0), q[c:d].min(axis=0) - p[a:b].max(axis=0)))
        if gaps @ gaps > eps2:
            continue
        if max(b - a, d - c) > TILE:
            m, k = (a + b) // 2, (c + d) // 2
            sides = [(a, m), (m, b)] if b - a > TILE else [(a, b)]
            others = [(c, k), (k, d)] if d - c > TILE else [(c, d)]
            todo += [(*s, *o) for s in sides for o in others]
            continue
        cosines = products(u[a:b], v[c:d])
        linked = cosines >= threshold
        for i, j in np.argwhere(np.abs(cosines - threshold) < SLACK):
            linked[i, j] = exact_cosine(x[a + i], y[c + j]) >= threshold
        if same:
            linked &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not linked.any():
            continue
        n_x[a:b] += linked @ weight_y[c:d]
        n_y[c:d] += linked.T @ weight_x[a:b]
        for i, j in spanning(linked):
            forest.join(a + i, shift + c + j)
    return (n_x + n_y, n_y[:0], forest) if same else (n_x, n_y, forest)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a tile that connect what all of its links connect: at most one less than its rows and columns."""
    rows, columns = np.nonzero(linked.any(axis=1))[0], np.nonzero(linked.any(axis=0))[0]
    left = set(rows.tolist())
    edges, free = [], linked.copy()
    free_columns = np.zeros(linked.shape[1], dtype=bool)
    free_columns[columns] = True
    while left:
        start = left.pop()
        around = [start]
        while around:
            i = around.pop()
            for j in np.flatnonzero(free[i] & free_columns):
                free_columns[j] = False
                edges.append((i, int(j)))
                for other in np.flatnonzero(free[:, j]):
                    if other in left:
                        left.discard(int(other))
                        edges.append((int(other), int(j)))
                        around.append(int(other))
    return edges


def links(scratch: Scratch, blocks: DataFrame, pairs: DataFrame, axes: tuple[int, np.ndarray], threshold: float) -> DataFrame:
    """(node, n, root): per pair of blocks and vector with links in it, the number of rows it links to and
    a vector it hangs together with."""
    named = blocks.select("block", "vectors", F.size("key").alias("rows"), "members")
    side = lambda name: named.select(F.col("block").alias(name), F.struct("vectors", "rows", "members").alias(name + "_rows"))
    # Which block is looked up first is left to a hash: an early block is not the first of all its pairs.
    turned = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    dealt = pairs.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("b"))
    both = dealt.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_rows", "b_rows")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                numbers = [batch.column(c)[r].as_py() for c in ("a", "b")]
                sides = [batch.column(c)[r] for c in ("a_rows", "b_rows")]
                x, y = (s["vectors"].values.to_numpy(zero_copy_only=False).reshape(s["rows"].as_py(), -1) for s in sides)
                weights = [s["members"].values.to_numpy() for s in sides]
                same = numbers[0] == numbers[1]
                n_x, n_y, forest = joined(x, y, *weights, same, axes, threshold)
                n = np.concatenate([n_x, n_y])
                at = np.flatnonzero(n)
                if len(at):
                    names = numbers[0] * MOST_ROWS + np.arange(len(x))
                    names = names if same else np.concatenate([names, numbers[1] * MOST_ROWS + np.arange(len(y))])
                    roots = np.array([forest.root(int(i)) for i in at])
                    yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(n[at]), pa.array(names[roots])], names=["node", "n", "root"])

    return both.mapInArrow(found, "node long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, label: str | None = "label", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Two rows link when their labels are equal and not null (``label=None``: all rows) and the cosine of
    their vectors, in double precision, is at least ``threshold``. component_id is the smallest
    vec_id reachable over links, kept whether it is the row's own. Copies are one vector with a weight,
    so groups of any size cost one row; links between different vectors are all found and counted.
    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and so
    do vectors of different length. Rows that repeat are rows of their own and link like any copies. A
    null vec_id takes part but names no component: its component_id is the smallest id that is not null,
    null if there is none, and it is never kept. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    small_batches(vectors.sparkSession)
    eps = math.sqrt(max(1e-12, 2 - 2 * threshold))
    rows = scratch.cut(marked_rows(vectors, vec_id, embedding, label))
    nodes = scratch.cut(distinct_vectors(rows))
    n = nodes.count()
    keyed = rows.select("vec_id", "key", "key2", F.col("vector").isNotNull().alias("usable"))
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if n == 0:
        return alone(keyed)
    axes = principal_axes(nodes)
    blocks = scratch.cut(blocks_of(scratch, nodes, n, eps, axes))
    pairs = close_pairs(scratch, blocks, blocks.count(), eps)
    linked = scratch.cut(links(scratch, blocks, pairs, axes, threshold))
    named = blocks.select("block", F.posexplode(F.arrays_zip("key", "key2", "members", "least")).alias("at", "own"))
    names = named.select((F.col("block") * MOST_ROWS + F.col("at")).alias("node"), "own.*")
    sums = linked.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(scratch, linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    many = scratch.cut(names.join(sums, "node", "left").where("n is not null or members > 1"))
    grouped = many.join(roots.withColumnRenamed("root", "found"), "node", "left").withColumn("root", F.coalesce("found", F.col("node")))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    result = scratch.cut(grouped.join(smallest, "root").select("key", "key2", "members", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), "component_id"))

    total = rows.count()
    often = F.col("members") > max(1, total // MOST_HOT)  # fewer than MOST_HOT vectors can be so frequent
    hot, rest = result.where(often).drop("members"), result.where(~often).drop("members")
    first = keyed.join(F.broadcast(hot), ["key", "key2"], "left")
    done = first.where("n_links is not null").select("vec_id", "n_links", "component_id")
    open_rows = first.where("n_links is null").select("vec_id", "key", "key2", "usable")
    named = open_rows.where("usable").join(rest, ["key", "key2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    both = done.unionByName(named).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return both.unionByName(alone(open_rows.where("not usable")))
