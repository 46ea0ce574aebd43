"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
The Manhattan distance of two such vectors is never above the bit distance, so
pairs within ``distance`` bits are found by a range join on the vectors and
then verified on the bits. The join's grid: the segments are dealt into
``distance // 2 + 1`` parts; of two vectors within the distance one part is
within 1, that is, it differs in one coordinate at most. A grid cell is a part
with one coordinate left open, so every such pair meets in a cell.

Cells of more than ``CELL_ROWS`` fingerprints are cut into blocks and each pair
of blocks is a cell of its own, so no task holds an unbounded cell and no pair
is lost. A cell emits a spanning forest of its links, not its pairs; copies
collapse to one fingerprint before the join.

Null, empty and odd rows: a null text has no words, and a text without words
has fingerprint zero, which links like any other; a null doc_id is a member
but never names a component (null if all its members lack an id); repeated rows
are reported once each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import byte_slices, cut_lineage, text_key
from tidepool.llm.graph import components
from tidepool.llm.passages import keyed, same_row, stage_table

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 32
CELL_ROWS = 4096
BROADCAST_ROWS = 100_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    count = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for a in range(0, count, 1 << 16):
        part = np.ascontiguousarray(hashes[a : a + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, print) of each row; the print is the fingerprint as a
    signed long, the row_key tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
                prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(prints)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "print"])

    return keyed(docs).mapInArrow(run, "doc_id long, row_key long, print long")


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """Bits set in each two-bit segment: (fingerprints, 32), values 0 to 2."""
    x = prints.astype(np.uint64)
    pairs = (x & np.uint64(0x5555555555555555)) + ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    shifts = 2 * np.arange(SEGMENTS, dtype=np.uint64)
    return ((pairs[:, None] >> shifts) & np.uint64(3)).astype(np.int8)


def grid_cells(prints: np.ndarray, distance: int) -> np.ndarray:
    """(fingerprints, segments): the cell of each, one for each open coordinate.

    A cell's number holds the open coordinate and the two-bit counts of the
    other coordinates of its part."""
    x = prints.astype(np.uint64)
    pairs = (x & np.uint64(0x5555555555555555)) + ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    cells = np.empty((len(x), SEGMENTS), np.uint64)
    for part in np.array_split(np.arange(SEGMENTS), distance // 2 + 1):
        first, size = int(part[0]), len(part)
        own = (pairs >> np.uint64(2 * first)) & np.uint64((1 << 2 * size) - 1)
        for c in part:
            rest = own & ~(np.uint64(3) << np.uint64(2 * (int(c) - first)))
            cells[:, c] = rest << np.uint64(5) | np.uint64(c) if size < 30 else _mixed(rest, int(c))
    return cells.view(np.int64)


def _mixed(rest: np.ndarray, c: int) -> np.ndarray:
    """For one part of all segments the counts fill the word: cells are hashed
    (two cells that fall together only add pairs to verify)."""
    with np.errstate(over="ignore"):
        return (rest ^ np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(c) << np.uint64(58)


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Within the distance: the lower bound first, then the bits."""
    ok = np.flatnonzero(np.abs(segment_counts(a) - segment_counts(b)).sum(axis=1, dtype=np.int16) <= distance)
    out = np.zeros(len(a), bool)
    out[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= distance
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indices over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


SMALL = 24


def cell_links(cell: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by cell, as a spanning forest of the fingerprints."""
    n = len(cell)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    size = np.repeat(sizes, sizes)
    left = size - (np.arange(n) - np.repeat(starts, sizes))  # rows of the cell from this one on
    found_a, found_b = [], []
    for shift in range(1, SMALL):  # all pairs of small cells, a shift at a time
        i = np.flatnonzero((size <= SMALL) & (left > shift))
        if not len(i):
            break
        ok = near(prints[i], prints[i + shift], distance)
        found_a.append(i[ok]), found_b.append(i[ok] + shift)
    for s, m in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):  # breadth first over what is not reached yet
        rest, queue = np.arange(s, s + m), []
        while len(rest):
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            at = queue.pop()
            ok = np.bitwise_count(prints[at] ^ prints[rest]) <= distance  # the cell has bounded it already
            hit = rest[ok]
            found_a.append(np.full(len(hit), at)), found_b.append(hit)
            queue.extend(hit)
            rest = rest[~ok]
    if not found_a:
        return prints[:0], prints[:0]
    distinct, code = np.unique(prints, return_inverse=True)
    root = roots(len(distinct), code[np.concatenate(found_a)], code[np.concatenate(found_b)])
    moved = np.flatnonzero(root != np.arange(len(distinct)))
    return distinct[moved], distinct[root[moved]]


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Verified links u, v between distinct fingerprints (column print); the
    links of each cell are given as a spanning forest."""
    if distance >= 2 * SEGMENTS:
        raise ValueError("the distance must be under 64 bits")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("print").to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 8192):
                part = x[a : a + 8192]
                cell = grid_cells(part.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.ravel()), pa.array(np.repeat(part, SEGMENTS))], ["cell", "print"]
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_s, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(c, s, p):
            group = np.cumsum(np.r_[0, (c[1:] != c[:-1]) | (s[1:] != s[:-1])]) if len(c) else c
            u, v = cell_links(group, p.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            held_c, held_s, held_p = (
                np.concatenate([h, batch.column(n).to_numpy(zero_copy_only=False)])
                for h, n in ((held_c, "cell"), (held_s, "slot"), (held_p, "print"))
            )
            if not len(held_c):
                continue
            # The last cell may go on in the next batch.
            done = int(np.flatnonzero((held_c == held_c[-1]) & (held_s == held_s[-1]))[0])
            if done > 1 << 16:
                yield out(held_c[:done], held_s[:done], held_p[:done])
                held_c, held_s, held_p = held_c[done:], held_s[done:], held_p[done:]
        yield out(held_c, held_s, held_p)

    celled = prints.select("print").mapInArrow(cells, "cell long, print long")
    full = cut_lineage(
        celled.groupBy("cell").count().where(F.col("count") > CELL_ROWS).withColumnRenamed("cell", "full_cell")
    )
    few = full.count()
    hint = F.broadcast if few <= BROADCAST_ROWS else lambda df: df
    met = celled.join(hint(full), F.col("cell") == F.col("full_cell"), "left") if few else celled.withColumn("count", F.lit(None).cast("long"))
    blocks = F.ceil(F.col("count") / CELL_ROWS)
    own = F.pmod(F.xxhash64("print"), blocks)
    # Of blocks i <= j the pair i * blocks + j: a fingerprint goes to the pairs that hold its block.
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j)
    )
    slots = F.when(F.col("count").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)
    dealt = met.select("cell", F.explode(slots).alias("slot"), "print") if few else met.select("cell", F.lit(-1).cast("long").alias("slot"), "print")
    dealt = dealt.repartition("cell", "slot").sortWithinPartitions("cell", "slot")
    return dealt.mapInArrow(joined, "u long, v long")


def rooted(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """doc_id, row_key, print and root (the smallest print that links reach) of each row."""
    rows = stage_table(fingerprints(docs, shingle))
    found = components(links(rows.select("print").distinct(), distance)).withColumnRenamed("node", "print")
    return rows.join(found, "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Fingerprint and component of each row of ``docs`` (doc_id, text).

    Fingerprints within ``distance`` bits are linked; a component is what links
    reach. Returns doc_id, fingerprint (16 hexadecimal digits) and component_id
    (its smallest doc_id).
    """
    rows = rooted(docs, shingle, distance)
    # Written first, so that the join below has two plain sides and a hot component can be split.
    names = stage_table(rows.groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("component_id")))
    return rows.join(names, F.col("root") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with its columns, one row of each component: that of the smallest
    doc_id (null last), of equal ids that of the smallest text hash."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    kept = rooted(docs, shingle, distance).groupBy("root").agg(F.min(place).alias("kept"))
    kept = stage_table(kept.select("kept.doc_id", "kept.row_key"))
    own = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text").cast("string")).alias("row_key"),
    )
    met = own.alias("b").join(kept.alias("k"), same_row("b", "k"), "left_semi")
    return met.dropDuplicates(["doc_id", "row_key"]).select("row.*")
