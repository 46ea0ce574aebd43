"""Suffix-array dedup with hash-compared suffixes.

Strings of 200 bytes that stand in two places select the same gram in both
(``passages``), so the suffix array is sparse: it holds one suffix for each
distinct content, the one that starts at the selected gram, and is made for
each shard of choices by itself. Suffixes are compared by their first
difference, found by a binary search over polynomial prefix hashes, so a
comparison takes a logarithmic number of steps; a bottom-up mergesort of all
the choices of a shard goes on in step. The parts before the grams are sorted
backwards in the same way. Common extensions of neighbours in the two orders,
checked byte by byte, tell for every window which contents of its choice hold
it (``shared_windows``); the work grows with the contents of a choice, not with
their pairs.

Contents that stand in two places as a whole (equal 128-bit hashes: 64 of the
selected gram and 64 of the content) are removed there without a sort.

A shard has a bounded number of contents and the contents of one choice are
bounded (``passages.FULL``).

Null, empty and odd rows: a null text is empty; texts under 200 bytes stay
whole; repeated rows are places of their own, so both lose what they share; a
null doc_id is a row like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import winnow
from tidepool.llm.passages import SPANS, Kind, Rule, keep_mask, keyed, map_kept, packed, removed_spans

WINDOW = 200
GRAM = 32
SHARD_CONTENTS = 6_000


class HashedText:
    """Prefix hashes of a byte string; common extensions by binary search."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.hashes = winnow.PrefixHash(winnow.BYTE_VALUES[raw])

    def _search(self, limit: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros(len(limit), np.int64), limit.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = same(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at i and j have in common, up to limit."""
        return self._search(limit, lambda n: self.hashes.spans(i, i + n) == self.hashes.spans(j, j + n))

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Bytes in common before i and j, up to limit."""
        return self._search(limit, lambda n: self.hashes.spans(i - n, i) == self.hashes.spans(j - n, j))

    def ordered(self, i: np.ndarray, i_end: np.ndarray, j: np.ndarray, j_end: np.ndarray) -> np.ndarray:
        """Whether the suffix i:i_end sorts before or with j:j_end."""
        shorter = np.minimum(i_end - i, j_end - j)
        n = self.forward(i, j, shorter)
        over = n == shorter
        last = len(self.raw) - 1
        first_less = self.raw[np.minimum(i + n, last)] < self.raw[np.minimum(j + n, last)]
        return np.where(over, i_end - i <= j_end - j, first_less)


def merge_sort(text: HashedText, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the suffixes start:end within each group (rows of a group
    stand together). All groups are merged in step, runs of 1, 2, 4 ... rows."""
    n = len(start)
    order = np.arange(n)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else order
    ends = np.r_[begins[1:], n]
    width = 1
    while n and (ends - begins).max() > width:
        count = -(-(ends - begins) // (2 * width))
        left = np.repeat(begins, count) + 2 * width * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        stop = np.repeat(ends, count)
        mid, stop = np.minimum(left + width, stop), np.minimum(left + 2 * width, stop)
        merged, at = order.copy(), left.copy()
        i, j = left.copy(), mid.copy()
        live = np.flatnonzero(j < stop)
        while len(live):
            a, b = order[i[live]], order[j[live]]
            first = text.ordered(start[a], end[a], start[b], end[b])
            merged[at[live]] = np.where(first, a, b)
            i[live] += first
            j[live] += ~first
            at[live] += 1
            live = live[(i[live] < mid[live]) & (j[live] < stop[live])]
        for k in np.flatnonzero((i < mid) & (mid < stop)):  # what is left of the first run comes last
            merged[at[k] : stop[k]] = order[i[k] : mid[k]]
        order = merged
        width *= 2
    return order


def equal_bytes(raw: bytes, i: int, j: int, n: int) -> int:
    """Of ``n`` bytes that the hashes call equal, how many are before a byte differs."""
    if raw[i : i + n] == raw[j : j + n]:
        return n
    return next(k for k in range(n) if raw[i + k] != raw[j + k])


def ranked(raw: bytes, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes start:end within each group, and how many bytes
    each has in common with the one before it (-1 for the first of a group).
    Common extensions come from hashes and are checked byte by byte."""
    text = HashedText(np.frombuffer(raw, np.uint8))
    order = merge_sort(text, start, end, group)
    start, end = start[order], end[order]
    common = np.full(len(order), -1, np.int64)
    at = np.flatnonzero(group[:-1] == group[1:])
    size = np.minimum(end - start, np.roll(end - start, -1))[at]
    common[at + 1] = text.forward(start[at], start[at + 1], size)
    for i in at.tolist():
        common[i + 1] = equal_bytes(raw, int(start[i]), int(start[i + 1]), int(common[i + 1]))
    return order, common


def nearest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The most bytes that each suffix has in common with any other of its group."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], -1))
    return out


def shared_windows(bodies: list[bytes], lead: np.ndarray, group: np.ndarray, once: np.ndarray, window: int) -> list[list[dict]]:
    """For each content that stands in one place (``once``) the runs of its
    windows that another content of its group holds as far from the gram.

    The suffixes that start at the selected grams are sorted, and so are, read
    backwards, the parts before the grams. A window that starts ``l`` bytes
    before the gram (after it: negative) is equal in two contents where they have
    ``window - l`` bytes in common from the gram on and ``l`` before it: where in
    either order no smaller common extension lies between them. Numbering the stretches
    between smaller extensions gives two numbers for each content, and equal
    pairs of numbers are equal windows; no two contents are compared beyond
    neighbours."""
    n = len(bodies)
    sizes = np.array([len(b) for b in bodies], np.int64)
    joined = b"".join(bodies)
    base = np.cumsum(sizes) - sizes
    start, end = base + lead, base + sizes
    after, common = ranked(joined, start, end, group)
    before, common_back = ranked(joined[::-1], len(joined) - start, len(joined) - base, group)
    most_after, most_before = nearest(after, common), nearest(before, common_back)
    last = max(0, int((sizes - lead).max(initial=0)) - window)
    found = np.zeros((n, int(lead.max(initial=0)) + last + 1), bool)  # by content and the window's start
    for l in range(-last, int(lead.max(initial=0)) + 1):
        able = (most_before >= l) & (most_after >= window - l)
        if not able.any():
            continue
        numbers = np.empty((2, n), np.int64)
        numbers[0, after] = np.cumsum(common < window - l)
        numbers[1, before] = np.cumsum(common_back < l)
        rows = np.flatnonzero(able)
        key = numbers[0, rows] * (n + 1) + numbers[1, rows]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        rows = rows[order][np.append(same, False) | np.insert(same, 0, False)]
        rows = rows[once[rows]]
        found[rows, lead[rows] - l] = True
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edges == 1)
    until = np.nonzero(edges == -1)[1]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for row, x, y in zip(rows.tolist(), first.tolist(), until.tolist()):
        spans[row].append({"from": x, "until": y})
    return spans


def shard_spans(shard: pd.DataFrame, window: int) -> pd.DataFrame:
    shard = shard.drop_duplicates(["choice", "content"]).sort_values(["choice", "content"])
    spans = shared_windows(
        shard["text"].tolist(),
        shard["lead"].to_numpy(np.int64),
        shard["choice"].to_numpy(np.int64),
        shard["n"].to_numpy(np.int64) == 1,
        window,
    )
    out = shard[["choice", "content"]].assign(spans=spans)
    return out[out["spans"].map(len) > 0]


def digest_row(text: bytes, spans) -> tuple[int, int, int, str]:
    if not spans:
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    keep = keep_mask(len(text), spans)
    kept = np.frombuffer(text, np.uint8)[keep].tobytes()
    runs = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
    return len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()


def another_place(window: int) -> Rule:
    """A window repeats where it starts anywhere else."""

    def compare(texts: DataFrame, units: int) -> DataFrame:
        shards = max(1, -(-units // SHARD_CONTENTS))
        dealt = texts.withColumn("shard", F.pmod(F.xxhash64("choice"), F.lit(shards)))
        return dealt.groupBy("shard").applyInPandas(
            lambda shard: shard_spans(shard, window), f"choice long, content long, spans {SPANS}"
        )

    return Rule(
        aggregates=[F.count("*").alias("places")],
        shared=F.col("places") > 1,
        compared=F.col("contents") > 1,
        compare=compare,
        whole=F.col("n") > 1,
    )


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of
    ``docs`` (doc_id, text), after removing every byte covered by a string of
    ``window`` bytes that also starts anywhere else."""
    rows = keyed(docs)
    bodies = packed(rows)
    gone = removed_spans(rows, bodies, Kind("bytes", window, gram), another_place(window))
    return map_kept(
        bodies,
        gone,
        digest_row,
        ["n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )
