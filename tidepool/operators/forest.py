"""Isolation forest on vital panels: trees fitted in parallel, scoring with
an Arrow-batched pandas UDF.

Fit: every row draws, by a seeded hash, the trees whose sub-sample it joins
(expected ``sample_size`` rows per tree), so each tree's group is bounded by
construction; ``applyInPandas`` grows one tree per group with numpy. The
fitted forest is small (trees x 2 x sample_size nodes) and is shipped to the
scoring UDF. Scores follow the usual definition 2^(-E[h(x)] / c(psi)); the
label threshold is the training-score quantile at 1 - contamination.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidepool.operators.quantiles import quantiles

TREE_SCHEMA = "tree_id int, psi int, nodes string"


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.RandomState, max_depth: int) -> list:
    """Nodes as [feature, threshold, left, right, size] (feature -1 = leaf)."""
    nodes: list = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, int(len(idx))])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        free = np.flatnonzero(hi > lo)
        if len(free) == 0:
            return me
        f = int(rng.choice(free))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][0], nodes[me][1] = f, t
        nodes[me][2] = build(left, depth + 1)
        nodes[me][3] = build(right, depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def fit(panels: DataFrame, features: Sequence[str], id_col: str, n_trees: int = 100, sample_size: int = 256,
        seed: int = 13) -> DataFrame:
    """Trees as rows ``(tree_id, psi, nodes JSON)``."""
    n = panels.count()
    psi = int(min(sample_size, n))
    p = min(1.0, psi / max(n, 1))
    cut = int(p * (2**31 - 1))
    trees = F.filter(
        F.sequence(F.lit(0), F.lit(n_trees - 1)),
        lambda t: F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(2**31 - 1)) < cut,
    )
    sampled = panels.select(id_col, *features, F.explode(trees).alias("tree_id"))
    max_depth = int(np.ceil(np.log2(max(psi, 2))))
    feats = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values(id_col, kind="mergesort")
        x = pdf[feats].to_numpy(dtype=np.float64)
        nodes = _grow(x, np.random.RandomState(seed * 100003 + tid), max_depth)
        return pd.DataFrame({"tree_id": [tid], "psi": [len(x)], "nodes": [json.dumps(nodes)]})

    return sampled.groupBy("tree_id").applyInPandas(grow, TREE_SCHEMA)


def _paths(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Path lengths of all rows through one tree, level by level (numpy)."""
    feat, thr, left, right, leaf_c = tree
    i = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = feat[i] >= 0
    while active.any():
        f = feat[i[active]]
        go_left = x[np.flatnonzero(active), f] < thr[i[active]]
        i[active] = np.where(go_left, left[i[active]], right[i[active]])
        depth[active] += 1
        active = feat[i] >= 0
    return depth + leaf_c[i]


def score_column(trees: DataFrame, features: Sequence[str]) -> Column:
    """Anomaly score in (0, 1] (higher = more isolated) as a pandas UDF; the
    forest (bounded size) is read once and shipped with the UDF."""
    rows = trees.orderBy("tree_id").collect()
    forest = []
    for r in rows:
        a = np.array(json.loads(r.nodes), dtype=np.float64)
        forest.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64),
                       np.array([_c(n) for n in a[:, 4]])))
    c_psi = float(np.mean([_c(r.psi) for r in rows])) or 1.0

    @pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
        h = sum(_paths(t, x) for t in forest)
        return pd.Series(np.power(2.0, -(h / len(forest)) / c_psi))

    return score(*[F.col(f) for f in features])


def threshold(scored: DataFrame, score_col: str, contamination: float) -> float:
    """Score above which the training rows' top ``contamination`` share lies."""
    return float(quantiles(scored, [], score_col, {"t": 1 - contamination}).first()["t"])
