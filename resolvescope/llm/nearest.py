"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

A neighbour of a neighbour is likely a neighbour. The graph starts from blocks of rows that lie close
on random directions; each round brings the vectors of every node's neighbours together in one row,
compares them with one another and keeps what improves a list. Queries walk the finished graph: the
unvisited nodes of a query's beam are joined with the graph, their neighbours with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resolvescope.llm.common import Scratch, lists_of

NEIGHBOURS = 24
"""Length of a node's list."""

BLOCK = 192
"""Rows of one starting block, about."""

DIRECTIONS = 3
ROUNDS = 20
"""Most rounds; they end earlier, by STOP."""

BEAM = 192
STOP = 0.002
"""Rounds end when fewer than this share of the lists' entries are new."""

SEED = 42


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part: id and vector not null, all components finite, not all zero."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null and size(vector) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the commonest length."""
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows if common is None else rows.where(F.size("vector") == common["width"])


def distinct_vectors(scratch: Scratch, rows: DataFrame, k: int) -> DataFrame:
    """(node, vector, members): one row per distinct vector, named by its smallest id, with its k + 1
    smallest ids. More can never be among the k nearest of a query, its own copies included."""
    # Few rows of a group pass the row-number limit of each task, so a vector of a third of all rows is no hot key.
    ranked = rows.withColumn("vector", F.transform("vector", lambda x: x + 0.0)).withColumn("key", F.xxhash64("vector"))
    order = F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))
    few = ranked.distinct().withColumn("place", order).where(F.col("place") <= k + 1)
    return scratch.cut(few.groupBy("key", "vector").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members")).select("node", "vector", "members"))


def _matrix(column: pa.Array) -> np.ndarray:
    values, ends = lists_of(column)
    return values.reshape(len(ends) - 1, -1) if len(ends) > 1 else np.zeros((0, 0))


def _distances(x: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", x, x)
    return np.maximum(squares[:, None] + squares[None, :] - 2 * (x @ x.T), 0)


EDGES = "node long, other long, distance double, fresh boolean"


def _edge_batch(node, other, distance, fresh) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(distance), pa.array(fresh)], names=["node", "other", "distance", "fresh"])


def starting_graph(nodes: DataFrame, width: int, n: int, neighbours: int) -> DataFrame:
    """Edges from the best of each block, over blocks of DIRECTIONS random trees.

    A tree's levels compare the projections on random directions with their medians over a sample, so a
    block is a cell of about BLOCK rows. Cells are dealt by hash; inside, rows are compared in pieces of
    BLOCK to 2 BLOCK, so a cell of any size takes bounded memory and linear time.
    """
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    random = np.random.default_rng(SEED)
    planes = random.normal(size=(DIRECTIONS, max(depth, 1), width))
    # The medians are taken over a bounded sample; they only shape the blocks.
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(min(1.0, 4096 / max(n, 1)) * (1 << 20)) + 1).select("vector").limit(8192).collect()
    points = np.array([r[0] for r in sample]) if sample else np.zeros((1, width))
    medians = np.median(points @ planes.reshape(-1, width).T, axis=0).reshape(DIRECTIONS, -1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            if not len(x):
                continue
            for d in range(DIRECTIONS):
                above = (x @ planes[d].T > medians[d])[:, :depth]
                cell = above @ (1 << np.arange(depth)) if depth else np.zeros(len(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64) * DIRECTIONS + d), batch.column("node"), batch.column("vector")], names=["cell", "node", "vector"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def piece(rows):
            ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
            d = _distances(x)
            np.fill_diagonal(d, np.inf)
            k = min(neighbours, len(ids) - 1)
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
            at = np.repeat(np.arange(len(ids)), k)
            return _edge_batch(ids[at], ids[best.ravel()], d[at, best.ravel()], np.ones(len(at), dtype=bool))

        current = None
        for batch in batches:
            x, ids, cell = _matrix(batch.column("vector")), batch.column("node").to_numpy(), batch.column("cell").to_numpy()
            for c, i, v in zip(cell, ids, x):
                if (c != current or len(held) >= 2 * BLOCK) and len(held) > 1:
                    yield piece(held)
                    held = held[-1:] if c == current else []  # one row links the pieces of a cell
                elif c != current:
                    held = []
                current = c
                held.append((i, v))
        if len(held) > 1:
            yield piece(held)

    placed = nodes.select("node", "vector").mapInArrow(cells, "cell long, node long, vector array<double>")
    return placed.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(compared, EDGES)


def shortest(edges: DataFrame, neighbours: int) -> DataFrame:
    """The nearest entries of each node's list; an entry that was there before is not fresh."""
    once = edges.groupBy("node", "other").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = F.row_number().over(Window.partitionBy("node").orderBy("distance", "other"))
    return once.withColumn("place", order).where(F.col("place") <= neighbours).drop("place")


def descend(scratch: Scratch, nodes: DataFrame, edges: DataFrame, neighbours: int) -> DataFrame:
    """One round: every node introduces its neighbours, and those who list it, to one another.

    Who lists a node is taken up to twice the list's length, nearest first: lists are symmetric enough
    that a popular node need not introduce all of them, and its row stays bounded.
    """
    reverse = edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "distance", "fresh")
    near = Window.partitionBy("node").orderBy("distance", "other")
    reverse = reverse.withColumn("place", F.row_number().over(near)).where(F.col("place") <= 2 * neighbours).drop("place")
    around = edges.unionByName(reverse).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
    worst = edges.groupBy("node").agg(F.max("distance").alias("worst"), F.count("*").alias("n")).select(F.col("node").alias("other"), F.when(F.col("n") < neighbours, float("inf")).otherwise(F.col("worst")).alias("worst"))
    known = nodes.select(F.col("node").alias("other"), F.transform("vector", lambda x: x.cast("float")).alias("vector")).join(worst, "other", "left")
    rows = around.join(known, "other").select("node", "other", "fresh", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "vector")
    dealt = rows.repartition("node").sortWithinPartitions("node")

    def introduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def meet(groups):
            out = [[], [], []]
            for ids, fresh, worst, x in groups:
                if len(ids) < 2 or not fresh.any():
                    continue
                d = _distances(x)
                better = (d < worst[:, None]) & (fresh[:, None] | fresh[None, :])
                np.fill_diagonal(better, False)
                a, b = np.nonzero(better)
                for column, value in zip(out, (ids[a], ids[b], d[a, b])):
                    column.append(value)
            if not sum(map(len, out[0])):
                return None
            node, other, distance = (np.concatenate(c) for c in out)
            order = np.lexsort((distance, other, node))
            node, other, distance = node[order], other[order], distance[order]
            first = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])]
            return _edge_batch(node[first], other[first], distance[first].astype(np.float64), np.ones(int(first.sum()), dtype=bool))

        rest = None
        for batch in batches:
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "other", "fresh", "worst")] + [_matrix(batch.column("vector"))]
            if rest is not None:
                arrays = [np.concatenate([r, a]) for r, a in zip(rest, arrays)]
            node = arrays[0]
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            ends = np.r_[starts[1:], len(node)]
            found = meet([tuple(a[s:e] for a in arrays[1:]) for s, e in zip(starts[:-1], ends[:-1])])
            rest = [a[starts[-1]:] for a in arrays]
            if found is not None:
                yield found
        if rest is not None and (found := meet([tuple(rest[1:])])) is not None:
            yield found

    proposed = dealt.mapInArrow(introduced, EDGES)
    return scratch.cut(shortest(edges.withColumn("fresh", F.lit(False)).unionByName(proposed), neighbours))


def build_graph(scratch: Scratch, nodes: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(node, other, distance, fresh) edges of the neighbour graph; distances are squared."""
    n = nodes.count()
    first = nodes.select("vector").first()
    if first is None:
        return scratch.spark.createDataFrame([], EDGES)
    edges = scratch.cut(shortest(starting_graph(nodes, len(first[0]), n, neighbours), neighbours))
    for _ in range(rounds):
        following = descend(scratch, nodes, edges, neighbours)
        scratch.drop(edges)
        edges = following
        if edges.where("fresh").count() < STOP * n * neighbours:
            break
    return edges


def search(scratch: Scratch, nodes: DataFrame, edges: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, other, distance): the ``beam`` best nodes that a greedy walk finds for each query.

    The walk goes on until every node of every beam is expanded. A step only adds nodes that are nearer
    than the worst of a full beam, so it ends.

    ``queries``: (query, node, vector), where node is a node of the graph to start from. Each step joins
    the beam's nodes not yet expanded with their lists and with all that list them, and what is new with
    its vector. A node that few list is reached that way through its own list.
    """
    links = scratch.cut(edges.select("node", "other").unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    asked = queries.select("query", F.col("vector").alias("asked"))
    found = scratch.cut(queries.select("query", F.col("node").alias("other"), F.lit(0.0).alias("distance"), F.lit(False).alias("expanded")))
    distance = F.aggregate(F.zip_with("asked", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = Window.partitionBy("query").orderBy("distance", "other")
    while not found.where("not expanded").isEmpty():
        frontier = found.where("not expanded").select("query", F.col("other").alias("node"))
        reached = frontier.join(links, "node").select("query", "other").distinct().join(found.select("query", "other"), ["query", "other"], "left_anti")
        measured = reached.join(nodes.select(F.col("node").alias("other"), "vector"), "other").join(asked, "query").select("query", "other", distance.alias("distance"), F.lit(False).alias("expanded"))
        merged = found.withColumn("expanded", F.lit(True)).unionByName(measured)
        following = scratch.cut(merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam).drop("place"))
        scratch.drop(found)
        found = following
    return found


def nearest(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where ``is_query(vec_id)`` holds.

    Every usable row is in the graph. Equal vectors are one node with its k + 1 smallest ids, so copies
    neither crowd the lists nor are lost. Scores are Euclidean distances of the original vectors in
    double precision; ties go to the smaller id. A query with fewer than k other rows gets all of them.
    Vectors of another length than the commonest (the smaller of equally common ones) have no distance to
    the others and take no part, as queries or as candidates. Rows that repeat an id and vector count once; unusable ones are left
    out as queries and as candidates; an empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = of_one_length(usable(vectors, vec_id, embedding))
    nodes = distinct_vectors(scratch, rows, k)
    edges = build_graph(scratch, nodes)
    wanted = rows.where(is_query(F.col("vec_id"))).withColumn("vector", F.transform("vector", lambda x: x + 0.0)).distinct()
    asked = scratch.cut(wanted.join(nodes.select("node", "vector"), "vector").select(F.col("vec_id").alias("query"), "node", "vector"))
    found = search(scratch, nodes, edges, asked.select(F.col("node").alias("query"), "node", "vector").distinct())
    listed = found.join(nodes.select(F.col("node").alias("other"), F.col("members")), "other").select(F.col("query").alias("node"), F.sqrt("distance").alias("score"), F.explode("members").alias("vec_id"))
    order = Window.partitionBy("node").orderBy("score", "vec_id")
    few = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    ranked = asked.select("query", "node").join(few, "node").where("vec_id <> query")
    own = Window.partitionBy("query").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
