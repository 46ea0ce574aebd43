"""Exact top-k inner-product search with one KD-tree per shard.

Rows are dealt into shards of bounded size by a hash of a row number. Each
shard is a KD-tree (median splits on the widest side, tight bounding boxes). A
query walks a tree best-first: a box is opened in the order of the largest
inner product it can hold, and the walk ends when that bound is below the
query's kth score. A query first visits the shard it is dealt to itself; the
kth score it reaches there is carried into every other shard, so most boxes
are closed from the start.

Rows and queries of a shard reach a task sorted, rows first: the tree is built
once and the queries stream through it, however many Arrow batches they take.
Only beyond ``BLOCK_ROWS`` queries a shard is searched by several tasks, each
with a tree of its own.

Null, empty and odd rows: a vector that is null or holds a null or non-finite
component, or has a null id, takes no part. Rows that repeat an id are rows of
their own: each is a candidate of all others, also of those of its own id, and,
if its id is a query's, a query with ranks of its own. Only vectors of the
query's dimension are its candidates. Ties go to the smaller id. An empty table
gives an empty result. Scores are exact integers: sums that doubles (beyond
2**52) or 64 bits cannot hold are made of larger integers, and ranked so; a
score outside 64 bits is returned as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage

LEAF = 256
SHARD_ROWS = 16_384
BLOCK_ROWS = 65_536
#: Sums of products below this are exact as doubles, below ``LONG`` as 64-bit integers.
EXACT = float(1 << 52)
LONG = float(1 << 62)


def quantise(vectors, scale: float = 64.0) -> np.ndarray:
    """floor(scale * x) per component, as doubles (which hold them exactly)."""
    return np.floor(scale * np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def exact(points: np.ndarray, largest: float) -> np.ndarray:
    """The points in numbers whose sums of products up to ``largest`` are exact."""
    if largest < EXACT:
        return points
    if largest < LONG:
        return points.astype(np.int64)
    return np.array([[int(x) for x in row] for row in points], dtype=object)


class KdTree:
    """Median splits on the widest side down to ``leaf`` points; every node
    keeps the tight box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.span: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.span)
            rows = points[self.order[a:b]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            self.span.append((a, b))
            self.child.append(None)
            if parent >= 0:
                left, right = self.child[parent] or (-1, -1)
                self.child[parent] = (node, right) if side == 0 else (left, node)
            if b - a > leaf:
                axis = int(np.argmax(high[-1].astype(np.float64) - low[-1]))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
                todo.append((a + mid, b, node, 1))
                todo.append((a, a + mid, node, 0))
        self.low, self.high = np.stack(low), np.stack(high)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(nodes, queries): the largest inner product a box can hold."""
        return self.high @ np.maximum(queries, 0).T + self.low @ np.minimum(queries, 0).T


def search_tree(tree: KdTree, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float):
    """The k best (score, id) of one tree for one query (row ``own``); boxes whose bound is
    under the kth score - the caller's ``floor`` or one reached here - stay shut."""
    best_s, best_i = points[:0, 0], ids[:0]
    kth = floor
    heap = [(-bound[0], 0)]
    while heap:
        most, node = heapq.heappop(heap)
        if -most < kth:
            break
        if tree.child[node] is not None:
            for c in tree.child[node]:
                if bound[c] >= kth:
                    heapq.heappush(heap, (-bound[c], c))
            continue
        a, b = tree.span[node]
        scores = points[a:b] @ query
        keep = (scores >= kth) & (rows[a:b] != own)
        if not keep.any():
            continue
        best_s = np.concatenate([best_s, scores[keep]])
        best_i = np.concatenate([best_i, ids[a:b][keep]])
        if len(best_s) > k:
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
        if len(best_s) == k:
            kth = max(kth, rounded_down(best_s.min()))
    return best_s, best_i


def rounded_down(score) -> float:
    """A double that is not above the score."""
    as_double = float(score)
    return as_double if as_double <= score else float(np.nextafter(as_double, -np.inf))


class Shard:
    """The trees of a shard, one for each dimension."""

    def __init__(self, rows: pd.DataFrame, scale: float):
        self.scale, self.trees = scale, {}
        dims = rows["embedding"].map(len).to_numpy() if len(rows) else np.zeros(0, np.int64)
        for dim in np.unique(dims):
            own = rows[dims == dim]
            tree = KdTree(quantise(own["embedding"], scale))
            order = tree.order
            self.trees[int(dim)] = (tree, own["vec_id"].to_numpy(np.int64)[order], own["row"].to_numpy(np.int64)[order])

    def search(self, queries: pd.DataFrame, k: int) -> pd.DataFrame:
        """The k best of the shard for every query."""
        out: list[tuple] = []
        dims = queries["embedding"].map(len).to_numpy()
        for dim in np.unique(dims):
            if int(dim) not in self.trees:
                continue
            tree, ids, rows = self.trees[int(dim)]
            asked = queries[dims == dim]
            q = quantise(asked["embedding"], self.scale)
            largest = float(np.abs(q).max(initial=0)) * float(np.abs(tree.points).max(initial=0)) * max(int(dim), 1)
            points, exact_q = exact(tree.points, largest), exact(q, largest)
            bound = tree.bounds(q)
            if largest >= EXACT:  # what rounding may have taken
                bound = bound + 4 * np.finfo(float).eps * max(int(dim), 1) * (np.maximum(np.abs(tree.high), np.abs(tree.low)) @ np.abs(q).T)
            for j, (row, query_id, kth) in enumerate(zip(asked["row"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64), asked["kth"].to_numpy(np.float64))):
                s, i = search_tree(tree, points, ids, rows, exact_q[j], row, bound[:, j], k, kth)
                out += [(row, query_id, x, int(y)) for y, x in zip(s.tolist(), i.tolist())]
        found = pd.DataFrame(out, columns=["row", "query_id", "vec_id", "exact"])
        return found.assign(rank_score=found["exact"].map(lambda x: f"{x + SHIFT:040d}"), score=found["exact"].map(lambda x: max(-SPAN, min(SPAN, x)))).drop(columns="exact")


#: Scores as text of one length sort as the numbers do, also beyond 64 bits.
SHIFT = 10**39
SPAN = (1 << 63) - 1
FOUND = "row long, query_id long, vec_id long, rank_score string, score long"


def search_groups(batches: Iterator[pd.DataFrame], k: int, scale: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, block and kind: a shard's rows, then its queries."""
    key, held, shard = None, [], None
    for batch in batches:
        for group, part in batch.groupby(["shard", "block"], sort=False):
            if group != key:
                key, held, shard = group, [], None
            asked = part["asked"].to_numpy(bool)
            if not asked.all():
                held.append(part[~asked])
            if asked.any():
                if shard is None:
                    shard, held = Shard(pd.concat(held) if held else part[:0], scale), []
                yield shard.search(part[asked], k)


def top_k(embeddings: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The ``k`` rows of the largest quantised inner product for every query.

    ``is_query(vec_id column)`` picks the queries; every other row of the
    query's dimension is a candidate. Returns query_id, rank (from 1), vec_id,
    score. See the module's docstring for nulls, ties and repeated rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        .withColumns({"is_query": F.coalesce(is_query(F.col("vec_id")), F.lit(False)), "row": F.monotonically_increasing_id()})
    )
    rows = cut_lineage(rows)  # row numbers are fixed from here on
    counts = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    shards = max(1, -(-counts["n"] // SHARD_ROWS))
    blocks = max(1, -(-counts["q"] // BLOCK_ROWS))
    spread = F.xxhash64("row")
    whole = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    shut = F.lit(float("-inf"))

    def dealt(part: DataFrame, as_queries: bool) -> DataFrame:
        keys = [F.pmod(spread, F.lit(shards)).alias("shard"), F.lit(0).cast("long").alias("block"), F.lit(as_queries).alias("asked")]
        return part.select(*keys, "row", "vec_id", "embedding", shut.alias("kth"))

    cand = dealt(rows, False)
    asked = dealt(rows.where("is_query"), True)

    def search(cand: DataFrame, asked: DataFrame) -> DataFrame:
        both = cand.unionByName(asked).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "asked")
        return both.mapInPandas(lambda b: search_groups(b, k, scale), FOUND)

    at_home = cut_lineage(search(cand, asked))
    reached = at_home.groupBy("row").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    # A long may round up to the next double: a step below it is safe.
    least = F.col("least") - F.abs("least") * 2.0**-52
    others = (
        asked.drop("kth", "block")
        .withColumnRenamed("shard", "home")
        .join(reached.select("row", least.alias("kth")), "row", "left")
        .withColumns({"kth": F.coalesce("kth", shut), "block": F.pmod(F.shiftright(spread, 20), F.lit(blocks)), "shard": F.explode(whole(shards))})
        .where("shard <> home")
        .drop("home")
    )
    found = at_home
    if shards > 1:
        found = found.unionByName(search(cand.withColumn("block", F.explode(whole(blocks))), others))
    order = Window.partitionBy("row").orderBy(F.desc("rank_score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
