"""Scores of (query, document) pairs that share terms, summed where a document is.

Documents are dealt into pieces by their id, and every piece gets the queries (in
blocks of ``SLOTS``): an inverted index of the queries is built for a piece, its
documents stream through it in the order of their ids, and only a query's best go
on. No row is made for a term or for a pair that is not among the best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 2_048
#: Cells of documents x queries, and matches of terms, that are looked at together.
CELLS = 1_000_000


def distinct_numbers(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, by sorting (numpy's hashing takes 70 times as long)."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


class _Index:
    """The queries of a piece by term, and the best documents of each so far."""

    def __init__(self, queries: pa.Table, weights: Sequence[int], jaccard: bool, best: int | None):
        self.q, self.jaccard, self.best = queries["q"].combine_chunks(), jaccard, best
        self.weights = np.array(weights, float)
        self.size = np.array(queries["n"].combine_chunks().fill_null(0), float)
        terms = queries["terms"].combine_chunks().flatten()  # a query has one field
        per = np.diff(np.asarray(terms.offsets))
        code = terms.flatten().dictionary_encode()
        self.terms, codes = code.dictionary, np.asarray(code.indices)
        order = np.argsort(codes, kind="stable")
        self.slots = np.repeat(np.arange(len(self.q)), per)[order]
        self.first = np.searchsorted(codes[order], np.arange(len(self.terms) + 1))
        self.least = np.full(len(self.q), -np.inf)
        self.seen, self.held = 0, []

    def score(self, ids: pa.Array, doc: np.ndarray, field: np.ndarray, code: np.ndarray, size: np.ndarray) -> None:
        """Documents ``ids`` with their terms (position in ``ids``, field, code), by document."""
        often = self.first[code + 1] - self.first[code]
        upto = np.concatenate([[0], np.cumsum(np.bincount(doc, often, len(ids)))])
        start = 0
        while start < len(ids):
            end = min(int(np.searchsorted(upto, upto[start] + CELLS, "right")) - 1, start + CELLS // len(self.q))
            end = max(end, start + 1)
            lo, hi = np.searchsorted(doc, [start, end])
            self._some(ids.slice(start, end - start), doc[lo:hi] - start, field[lo:hi], code[lo:hi], often[lo:hi], size[start:end])
            start = end

    def _some(self, ids, doc, field, code, often, size) -> None:
        shape = (len(ids), len(self.q))
        pos = np.arange(often.sum()) + np.repeat(self.first[code] - np.cumsum(often) + often, often)
        cell = np.repeat(doc, often) * shape[1] + self.slots[pos]
        score = np.bincount(cell, np.repeat(self.weights[field], often), shape[0] * shape[1]).reshape(shape)
        if self.jaccard:
            score = score / (self.size + size[:, None] - score)
        found = np.bincount(cell, minlength=score.size).reshape(shape) > 0
        if self.best is not None:
            found &= score > self.least
            if len(ids) > self.best:
                kth = np.partition(np.where(found, score, -np.inf), len(ids) - self.best, axis=0)[len(ids) - self.best]
                found &= score >= kth
        at, slot = np.nonzero(found)
        self.held.append((ids.take(pa.array(at)), slot, score[at, slot], at + self.seen))
        self.seen += len(ids)
        if self.best is not None and sum(len(x[1]) for x in self.held) > CELLS:
            self._keep_best()

    def _keep_best(self) -> None:
        ids = pa.concat_arrays([x[0] for x in self.held])
        slot, score, at = (np.concatenate([x[i] for x in self.held]) for i in (1, 2, 3))
        order = np.lexsort((at, -score, slot))  # of equal scores the lesser id, which came first
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = order[rank < self.best]
        last = order[rank == self.best - 1]
        slots = np.concatenate([x[1] for x in self.held])
        self.least[slots[last]] = score[last]
        self.held = [(ids.take(pa.array(kept)), slots[kept], score[kept], at[kept])]

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.best is not None and self.held:
            self._keep_best()
        for ids, slot, score, _ in self.held:
            out = pa.array(score) if self.jaccard else pa.array(score.astype(np.int64))
            yield pa.RecordBatch.from_arrays([self.q.take(pa.array(slot)), ids, out], ["q", "d", "score"])
        self.held = []


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(piece, side, rows): stretches of rows of one piece and side."""
    for b in batches:
        key = np.stack([np.asarray(b.column("piece")), np.asarray(b.column("side"))])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield int(key[0, lo]), int(key[1, lo]), b.slice(lo, hi - lo)


def _entries(index: _Index, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, field, code) of the asked terms, and the number of terms of each row."""
    fields = rows.column("terms")
    inner = fields.flatten()
    n_fields = len(index.weights)
    words = inner.flatten()
    per = np.asarray(pc.fill_null(pc.list_value_length(inner), 0)).astype(np.int64)
    at = np.repeat(np.arange(len(per)), per)
    code = np.asarray(pc.fill_null(pc.index_in(words, value_set=index.terms), -1))
    hit = code >= 0
    return at[hit] // n_fields, at[hit] % n_fields, code[hit].astype(np.int64), per.reshape(-1, n_fields).sum(axis=1)


def _scored(weights: Sequence[int], jaccard: bool, best: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, queries, index, pending = None, [], None, None

        def flush():
            nonlocal pending
            if index is not None:
                if pending is not None:
                    index.score(*pending)
                    pending = None
                yield from index.results()

        for now, side, rows in _segments(batches):
            if now != piece:
                yield from flush()
                piece, queries, index = now, [], None
            if side == 0:
                queries.append(rows)
                continue
            if not queries:
                continue
            if index is None:
                index = _Index(pa.Table.from_batches(queries), weights, jaccard, best)
            row, field, code, size = _entries(index, rows)
            ids = rows.column("d")
            values = ids.to_pylist()
            new = np.array([True, *(a != b for a, b in zip(values, values[1:]))])
            doc = np.cumsum(new) - 1
            if pending is not None:  # the last document of the rows before may go on
                if pending[0][0].as_py() != values[0]:
                    index.score(*pending)
                else:
                    row, field, code = (np.concatenate(x) for x in ((np.zeros(len(pending[1]), int) - 1, row), (pending[2], field), (pending[3], code)))
                    size[0] += pending[4][0]
            starts = np.flatnonzero(new)
            doc, size = doc[np.maximum(row, 0)], np.add.reduceat(size, starts)
            # rows of one id may share a field's terms
            if pending is not None or len(starts) < len(values):
                one = distinct_numbers((doc * len(weights) + field) * len(index.terms) + code)
                doc, rest = np.divmod(one, len(weights) * len(index.terms))
                field, code = np.divmod(rest, len(index.terms))
            ids = ids.take(pa.array(starts))
            last = len(ids) - 1
            cut = np.searchsorted(doc, last)
            if last:
                index.score(ids.slice(0, last), doc[:cut], field[:cut], code[:cut], size[:last])
            pending = (ids.slice(last), doc[cut:] - last, field[cut:], code[cut:], size[last:])
            if best is None:
                yield from index.results()
        yield from flush()

    return run


def term_scores(queries: DataFrame, docs: DataFrame, weights: Sequence[int], best: int | None = None, jaccard: bool = False) -> DataFrame:
    """(q, d, score) of the pairs that share a term, for ``queries`` (q, n, terms) and
    ``docs`` (d, terms: an array of terms a field). The score is the sum of a field's
    weight for every term of the query in it; with ``jaccard`` (one field, one row a
    document) it is shared / (n + the document's terms - shared).

    Rows of one d count as one document. With ``best``, what goes on are each query
    row's ``best`` documents of a piece, of equal scores the lesser d: among them are
    all that a ranking by score and d takes first."""
    spark = docs.sparkSession
    parts, blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-queries.count() // SLOTS))
    kind = {f.name: f.dataType for f in [*queries.schema, *docs.schema] if f.name in ("q", "d")}

    def row(piece: Column, side: int, d: Column, q: Column, n: Column, terms: Column) -> list[Column]:
        null = F.lit(None)
        return [piece.cast("int").alias("piece"), F.lit(side).alias("side"), (null if d is None else d).cast(kind["d"]).alias("d"),
                (null if q is None else q).cast(kind["q"]).alias("q"), (null if n is None else n).cast("int").alias("n"), terms.alias("terms")]

    each_piece = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("own", each_piece)
    asked = asked.select(*row(F.col("block") * parts + F.col("own"), 0, None, F.col("q"), F.col("n"), F.array("terms")))
    held = docs.withColumn("own", F.pmod(F.xxhash64("d"), F.lit(parts)).cast("int"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else held.withColumn("block", F.lit(0))
    held = held.select(*row(F.col("block") * parts + F.col("own"), 1, F.col("d"), None, None, F.col("terms")))
    dealt = asked.unionByName(held).repartition(parts * blocks, "piece").sortWithinPartitions("piece", "side", "d")
    score = "double" if jaccard else "bigint"
    schema = f"q {kind['q'].simpleString()}, d {kind['d'].simpleString()}, score {score}"
    return dealt.mapInArrow(_scored(list(weights), jaccard, best), schema)
