"""Cross-tokenizer alignment by external spill counting.

Two tokenizers cut one byte string; a token of side A and one of side B are
linked where their byte ranges overlap. How often each id pair is linked in the
whole corpus tells which partners belong together, and every document gets the
counts of its own links back.

One pass in four steps, with two shuffles of blobs and none of single records:

1. Documents are tokenized where they are read, block by block (a few MB of
   text). The links of a block become pair-document records (pair, document,
   occurrences), sorted by pair with side B leading, dealt by radix (a mix of
   the B id) and packed into one zstd run for each radix partition. A pair that
   very many documents of the block hold goes out as one record for the block;
   the documents' own occurrences stay behind with the block (the block's
   blob), so frequent pairs are summed before they are shuffled.
2. A radix partition gathers the runs that reach it into sorted runs of bounded
   size, which spill as zstd frames to a file of the task. A k-way heap merge
   over the frames counts each pair; as side B leads, an id's largest count is
   known when its last pair has passed.
3. The runs are streamed once more, and what each record adds to its document is
   sent back, summed for each block.
4. A block's blob and its contributions meet again, and a row for each document
   comes out.

Step 1 must give the same blocks if a lost executor makes Spark repeat it: the
documents must come from files (or a checkpoint), not from an unordered shuffle.
A radix partition keeps its distinct pairs with their counts in memory, at most
(ids of A) x (ids of B) over the partitions; a text is tokenized as a whole, so
the longest text bounds a task from below. Nothing else grows with the corpus.

Null and odd rows: a null or empty text has no tokens (zeros, no hash), as has a
text whose tokens' bytes differ from the text (a normalized or unknown character).
Repeated rows, and rows of one or no doc_id, are documents of their own. An empty
table gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import byte_slices

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: A pair held by so many documents of a block goes out as one record.
COMMON = 32
#: Records that a radix partition sorts in memory before it spills them.
RUN_RECORDS = 2_000_000
#: Records of a frame.
FRAME = 65_536

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_BLOB = "part int, block long, kind int, blob binary"
_FIELDS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 for itself, the others in order from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> dict[bytes, int]:
    """Ids by token bytes of a byte-level BPE file, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    of = byte_level()
    return {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Sides:
    """Both tokenizers of a worker, and their ids as tables."""

    #: How byte-level files of this kind cut text before merging (a fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        ranks = byte_level_tokens(path_a)  # an id is the rank of its merge
        self.a = tiktoken.Encoding("a", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_a = max(ranks.values()) + 1
        self.n_b = self.b.vocab_size()
        if self.n_a * self.n_b >= 1 << 32:
            raise ValueError("an id pair must fit 32 bits")
        self.length_a = np.zeros(self.n_a, np.int64)
        for token, i in ranks.items():
            self.length_a[i] = len(token)
        self.bytes_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.n_b)]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # The text of an id in the groups, by what follows it: "," or "|" on side A, "," or ";" on side B.
        texts = [f"{i}{end}".encode() for end, n in ((",", self.n_a), ("|", self.n_a), (",", self.n_b), (";", self.n_b)) for i in range(n)]
        self.width = np.array([len(t) for t in texts], np.int8)
        self.digits = np.array(texts, f"S{self.width.max()}").view(np.uint8).reshape(len(texts), -1)
        self.filled = np.arange(self.digits.shape[1]) < self.width[:, None]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text; None where it has no tokens."""
        out: list = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = f" {text}"
            raw = whole.encode()
            if not text or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                out.append(None)
                continue
            a = self.a.encode_to_numpy(whole).astype(np.int64)
            out.append((a, np.array(b, np.int64)) if self.length_a[a].sum() == len(raw) else None)
        return out


def _marks(ends: np.ndarray, size: int) -> np.ndarray:
    mark = np.zeros(size + 1, bool)
    mark[ends] = True
    return mark


class Block:
    """The tokens of some documents side by side."""

    def __init__(self, sides: Sides, encoded: list):
        n = len(encoded)
        none = np.zeros(0, np.int64)
        self.n_a = np.array([0 if e is None else len(e[0]) for e in encoded], np.int64)
        self.n_b = np.array([0 if e is None else len(e[1]) for e in encoded], np.int64)
        a = np.concatenate([none, *[e[0] for e in encoded if e is not None]])
        b = np.concatenate([none, *[e[1] for e in encoded if e is not None]])
        ends_a, ends_b = np.cumsum(sides.length_a[a]), np.cumsum(sides.length_b[b])
        size = int(ends_a[-1]) if len(a) else 0
        in_a, in_b = _marks(ends_a, size), _marks(ends_b, size)
        cuts = np.flatnonzero(in_a | in_b)  # each ends the overlap of one pair of tokens
        at_a = np.cumsum(in_a[cuts]) - in_a[cuts]
        at_b = np.cumsum(in_b[cuts]) - in_b[cuts]
        document = np.repeat(np.arange(n), self.n_a)
        common_a, common_b = in_b[ends_a], in_a[ends_b]  # tokens that end a group
        self.n_groups = np.bincount(document[common_a], minlength=n)
        link_doc = document[at_a]
        self.n_links = np.bincount(link_doc, minlength=n)
        # Pair, then document, as one number; the pair has side B in front.
        key = np.sort((b[at_b] * sides.n_a + a[at_a]) * n + link_doc)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else none
        self.times = np.diff(np.append(first, len(key)))
        self.pair, self.doc = key[first] // max(n, 1), key[first] % max(n, 1)
        self.hashes = self._hashes(sides, a, b, common_a, common_b)

    def _hashes(self, sides: Sides, a, b, common_a, common_b) -> list[str]:
        """The digest of each document's groups."""
        group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
        per_a, per_b = np.bincount(group_a), np.bincount(group_b)
        code = np.empty(len(a) + len(b), np.int64)
        # Before a token stand those of its side, and of the other those of the groups before (side B: up to its own).
        code[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]] = a + sides.n_a * common_a
        code[np.arange(len(b)) + np.cumsum(per_a)[group_b]] = 2 * sides.n_a + b + sides.n_b * common_b
        text = sides.digits[code][sides.filled[code]]
        ends = np.concatenate([[0], np.cumsum(sides.width[code], dtype=np.int64)])[np.cumsum(self.n_a + self.n_b)]
        view, start, out = memoryview(text), 0, []
        for tokens, end in zip(self.n_a.tolist(), ends.tolist()):
            # The last group's ";" is no part of the text.
            out.append(hashlib.sha256(view[start : end - 1]).hexdigest() if tokens else "")
            start = end
        return out


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers of equal length, compressed."""
    raw = b"".join(x.astype("<u4").tobytes() for x in arrays)
    return struct.pack("<I", len(arrays)) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes, dtype: str = "<u4") -> list[np.ndarray]:
    (n,) = struct.unpack("<I", blob[:4])
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    return list(np.frombuffer(raw, dtype).reshape(n, -1))


def _mixed(b: np.ndarray, parts: int) -> np.ndarray:
    """The radix partition of a B id."""
    with np.errstate(over="ignore"):
        h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


#: Kinds of blob: what a block keeps; its pair-document records, or those of a whole block; what comes back for either.
_KEPT, _DOCS, _BLOCKS, _TO_DOCS, _TO_BLOCKS = range(5)


def _radix_runs(docs: Iterator[pa.RecordBatch], path_a: str, path_b: str, parts: int, block_bytes: int, common: int) -> Iterator[pa.RecordBatch]:
    sides = Sides(path_a, path_b)
    block = TaskContext.get().partitionId() << 32
    for whole in docs:
        for batch in byte_slices(whole, "text", block_bytes):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = Block(sides, sides.encode(texts))
            rows: list[tuple] = []
            starts = np.flatnonzero(np.concatenate([[True], own.pair[1:] != own.pair[:-1]])) if len(own.pair) else np.zeros(0, np.int64)
            held = np.diff(np.append(starts, len(own.pair)))
            often = held >= common
            stays = np.repeat(often, held)
            total = np.add.reduceat(own.times, starts) if len(starts) else own.times
            for kind, pair, doc, times in ((_DOCS, own.pair[~stays], own.doc[~stays], own.times[~stays]), (_BLOCKS, own.pair[starts][often], np.zeros(int(often.sum()), np.int64), total[often])):
                part = _mixed(pair // sides.n_a, parts)
                order = np.argsort(part.astype(np.int32), kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    i = order[cuts[p] : cuts[p + 1]]
                    rows.append((p, block, kind, _packed(pair[i], doc[i], times[i])))
            kept = {
                "doc_id": batch.column("doc_id").to_pylist(),
                "n_a": own.n_a.tolist(),
                "n_b": own.n_b.tolist(),
                "n_groups": own.n_groups.tolist(),
                "n_links": own.n_links.tolist(),
                "groups_sha256": own.hashes,
            }
            common_links = _packed(own.pair[stays], own.doc[stays], own.times[stays])
            head = zstandard.ZstdCompressor(level=1).compress(json.dumps(kept).encode())
            rows.append((block % parts, block, _KEPT, struct.pack("<I", len(head)) + head + common_links))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
            block += 1


class SpilledRuns:
    """Sorted runs of records in a file of this task, and their pairs' counts.

    A record is (pair, block, doc, occurrences, kind); a run holds about
    ``run_records`` of them, whole blobs, so that all records of a block and
    radix partition stand in one run."""

    def __init__(self, run_records: int = RUN_RECORDS, frame: int = FRAME):
        self.file = tempfile.TemporaryFile()
        self.most, self.frame = run_records, frame
        self.runs: list[tuple[int, int]] = []  # where a run's records lie
        self.sums: list[list[tuple[int, int]]] = []  # where the frames of a run's pair sums lie
        self.held: list[tuple] = []
        self.n = 0

    def _write(self, *columns: np.ndarray) -> tuple[int, int]:
        raw = zstandard.ZstdCompressor(level=1).compress(np.concatenate([c.astype("<i8") for c in columns]).tobytes())
        return self.file.seek(0, 2), self.file.write(raw)

    def _read(self, place: tuple[int, int], columns: int) -> np.ndarray:
        self.file.seek(place[0])
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(place[1])), "<i8").reshape(columns, -1)

    def add(self, block: int, kind: int, blob: bytes) -> None:
        pair, doc, times = _unpacked(blob)
        self.held.append((pair, np.full(len(pair), block), doc, times, np.full(len(pair), kind, np.int8)))
        self.n += len(pair)
        if self.n >= self.most:
            self.spill()

    def spill(self) -> None:
        if not self.n:
            return
        pair, block, doc, times, kind = (np.concatenate(c).astype(np.int64) for c in zip(*self.held))
        self.held, self.n = [], 0
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        self.runs.append(self._write(pair, block[order], doc[order], times[order], kind[order]))
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        sums = np.add.reduceat(times[order], first)
        self.sums.append([self._write(pair[first[i : i + self.frame]], sums[i : i + self.frame]) for i in range(0, len(first), self.frame)])

    def merged(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pairs, counts), ascending: a heap holds the last pair of each run's
        frame; up to the smallest of them every run is complete in memory."""
        here: dict[int, np.ndarray] = {}
        nxt = [0] * len(self.sums)
        heap: list[tuple[int, int]] = []

        def load(run: int) -> None:
            if nxt[run] < len(self.sums[run]):
                here[run] = self._read(self.sums[run][nxt[run]], 2)
                nxt[run] += 1
                heapq.heappush(heap, (int(here[run][0][-1]), run))

        for run in range(len(self.sums)):
            load(run)
        while heap:
            bound, run = heapq.heappop(heap)
            taken = []
            for r, frame in list(here.items()):
                k = int(np.searchsorted(frame[0], bound, side="right"))
                taken.append(frame[:, :k])
                if k < frame.shape[1]:
                    here[r] = frame[:, k:]
                else:
                    del here[r]
            both = np.concatenate(taken, axis=1)
            both = both[:, np.argsort(both[0], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], both[0][1:] != both[0][:-1]])) if both.shape[1] else np.zeros(0, np.int64)
            if len(first):
                yield both[0][first], np.add.reduceat(both[1], first)
            load(run)
            # Runs whose frame ended at the same pair still stand in the heap; drop them there and go on with their next frame.
            for r in [r for last, r in heap if r not in here]:
                heap = [x for x in heap if x[1] != r]
                heapq.heapify(heap)
                load(r)

    def counted(self, n_a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, their counts, and whether a count is its B id's highest."""
        parts = list(self.merged())
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(bool)
        pair, count = (np.concatenate(c) for c in zip(*parts))
        side = pair // n_a
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        top = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(side))))
        return pair, count, count == top

    def back(self, n_a: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(block, kind, contributions). Kind documents: (doc, best links, sum of
        counts) summed by document; kind blocks: (pair, best, count)."""
        pairs, counts, best = self.counted(n_a)
        for place in self.runs:
            pair, block, doc, times, kind = self._read(place, 5)
            at = np.searchsorted(pairs, pair)
            count, top = counts[at], best[at]
            order = np.lexsort((doc, kind, block))
            edge = np.flatnonzero(np.diff(block[order]) | np.diff(kind[order])) + 1
            for i in np.split(order, edge):
                if kind[i[0]] == _BLOCKS:
                    yield int(block[i[0]]), _TO_BLOCKS, np.stack([pair[i], top[i].astype(np.int64), count[i]])
                else:
                    first = np.flatnonzero(np.concatenate([[True], np.diff(doc[i]) != 0]))
                    sums = [np.add.reduceat(x, first) for x in (times[i] * top[i], times[i] * count[i])]
                    yield int(block[i[0]]), _TO_DOCS, np.stack([doc[i][first], *sums])


def _contributions(batches: Iterator[pa.RecordBatch], n_a: int, run_records: int) -> Iterator[pa.RecordBatch]:
    """Steps 2 and 3 over the blobs of a radix partition (or of several)."""
    runs = SpilledRuns(run_records)
    for batch in batches:
        kept = pc.equal(batch.column("kind"), _KEPT)
        if pc.any(kept).as_py():
            yield batch.filter(kept)
        for block, kind, blob in zip(*(batch.filter(pc.invert(kept)).column(c).to_pylist() for c in ("block", "kind", "blob"))):
            runs.add(block, kind, blob)
    runs.spill()
    rows: list[tuple] = []
    for block, kind, values in runs.back(n_a):
        rows.append((0, block, kind, struct.pack("<I", 3) + zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").tobytes())))
        if len(rows) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


def _block_rows(kept: bytes, back: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Step 4 for one block."""
    (head,) = struct.unpack("<I", kept[:4])
    rows = json.loads(zstandard.ZstdDecompressor().decompress(kept[4 : 4 + head]))
    pair, doc, times = (x.astype(np.int64) for x in _unpacked(kept[4 + head :]))
    best = np.zeros(len(rows["doc_id"]), np.int64)
    total = np.zeros(len(rows["doc_id"]), np.int64)
    shared = [_unpacked(blob, "<i8") for kind, blob in back if kind == _TO_BLOCKS]
    for kind, blob in back:
        if kind == _TO_DOCS:
            at, n_best, count = _unpacked(blob, "<i8")
            best[at] += n_best
            total[at] += count
    if len(pair):
        known, top, count = (np.concatenate(c) for c in zip(*shared))
        order = np.argsort(known)
        at = order[np.searchsorted(known, pair, sorter=order)]
        np.add.at(best, doc, times * top[at])
        np.add.at(total, doc, times * count[at])
    columns = [rows["doc_id"], rows["n_a"], rows["n_b"], rows["n_groups"], rows["n_links"], best, total, rows["groups_sha256"]]
    types = [pa.int64()] * 7 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in SCHEMA.split(", ")])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: blobs come sorted by block."""
    now, kept, back = None, b"", []
    for batch in batches:
        for block, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "blob"))):
            if block != now:
                if now is not None:
                    yield _block_rows(kept, back)
                now, back = block, []
            if kind == _KEPT:
                kept = blob
            else:
                back.append((kind, blob))
    if now is not None:
        yield _block_rows(kept, back)


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES, common: int = COMMON, run_records: int = RUN_RECORDS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), see ``SCHEMA``.

    ``path_a``: a byte-level BPE file; it encodes a space and the text.
    ``path_b``: a sentencepiece BPE model that adds the space itself."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_a = max(byte_level_tokens(path_a).values()) + 1
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = read.mapInArrow(lambda b: _radix_runs(b, path_a, path_b, parts, block_bytes, common), _BLOB)
    back = runs.repartition(parts, "part").mapInArrow(lambda b: _contributions(b, n_a, run_records), _BLOB)
    return back.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_documents, SCHEMA)
