"""Packing by power-of-two decomposition.

A document's ids (tokenizer ids, then the end id) are cut into as many full
sequences as fit and, of the rest, one piece for each bit that is set: 1,448
ids are cut into 1024 + 256 + 128 + 32 + 8. A piece is a sequence of its own,
so no sequence crosses documents and none is padded; sequences of one length
form a bucket, and the bucket leads the sequence id, so equal lengths stand
together in id order.

The plan has no shuffle: every row is cut where it is read.

Null and odd rows: a null text is an empty one (its only id is the end id); a
null doc_id stays null; repeated rows are packed once each. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import byte_slices
from tidepool.llm.token_alignment import byte_level

SEQUENCE = 2048
END_ID = 1
END = END_ID.to_bytes(4, "little")
#: Words whose ids a worker remembers before it forgets those met in one batch only.
CACHE_WORDS = 800_000


END_OF_WORD = "</w>"


def marked_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Ids by token bytes, the end of a word written as a zero byte.

    An id is the rank of its merge, and the 256 pairs of a byte and the mark rank
    before all merges, so merging the pair of least rank in ``word\\0`` does what
    the vocabulary's merges do, as each token is what its own bytes merge to
    (checked for the file in the tests). Words hold no zero byte."""
    of, ranks = byte_level(), {}
    for token, i in vocabulary.items():
        ends = token.endswith(END_OF_WORD)
        raw = bytes(of[c] for c in token.removesuffix(END_OF_WORD))
        if b"\0" not in raw:
            ranks[raw + b"\0" * ends] = i
    ranks[b"\0"] = max(vocabulary.values()) + 1  # never left alone
    return ranks


class WordIds:
    """Ids of whole texts from ids of their words.

    The vocabulary's rules never let a token hold ASCII white space, so a text
    has the ids of its white-space-separated words, one after another; words
    repeat, and each is tokenized once while it is remembered. Ids are kept as
    little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = {t: i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.ends_word = np.zeros(max(vocabulary.values()) + 2, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.latin = tiktoken.Encoding("latin", pat_str=r"[^\x00]+\x00", mergeable_ranks=marked_ranks(vocabulary), special_tokens={})
        self.seen: dict[bytes, bytes] = {}
        self.once: set[bytes] = set()  # remembered, but met in one batch only

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Words of Latin letters alone are one run of tokens each,
        which ends where a token ends a word; many are encoded as one text, by
        merges alone (``marked_ranks``)."""
        plain, rest = [], []
        for i, match in enumerate(map(_LATIN.fullmatch, words)):
            (plain if match else rest).append(i)
        out = [b""] * len(words)
        encode = self.tokenizer.encode_batch_fast
        for i, e in zip(rest, encode([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        for own in (plain[a : a + 1000] for a in range(0, len(plain), 1000)):
            ids = self.latin.encode_to_numpy("\0".join([words[i] for i in own]).lower() + "\0").astype("<u4")
            raw, start = ids.tobytes(), 0
            for i, end in zip(own, (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist(), strict=True):
                out[i] = raw[start:end]
                start = end
        return out

    def _learn(self, words: set[bytes]) -> None:
        """A comma or full stop right after an ASCII letter is a token of its
        own, so ``word,`` has the ids of ``word`` and those of ``,``."""
        ended = {w for w in words if w.endswith((b".", b",")) and w[-2:-1] in _LETTERS}
        new = list(((words - ended) | {w[:-1] for w in ended} | {b".", b","}) - self.seen.keys())
        self.seen.update(zip(new, self._ids(list(map(bytes.decode, new)))))
        for w in ended:
            self.seen[w] = self.seen[w[:-1]] + self.seen[w[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, then the end id."""
        # The vocabulary has no capitals; only a special token's name must be left as it is.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = set().union(*split)
        self.once -= words
        new = words - self.seen.keys()
        if len(self.seen) + len(new) > CACHE_WORDS:
            for w in self.once:
                self.seen.pop(w, None)
            self.once.clear()
            if len(self.seen) + len(new) > CACHE_WORDS:
                self.seen.clear()
                new = words
        if new:
            self._learn(new)
            self.once |= new
        get = self.seen.__getitem__
        return [b"".join(map(get, own)) + END for own in split]


_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_LETTERS = frozenset(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: What the tasks of one Python worker remember, by vocabulary file: bounded by ``CACHE_WORDS``.
_remembered: dict[str, WordIds] = {}


def cut(total: int, longest: int = SEQUENCE) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids, largest first."""
    start = 0
    while start < total:
        length = min(longest, 1 << ((total - start).bit_length() - 1))
        yield start, length
        start += length


def pack(docs: DataFrame, tokenizer_path: str, longest: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text).

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and bucket (log2 of the length), with ``with_ids`` also the ids. ``longest``
    is a power of two.
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _remembered.get(tokenizer_path) or _remembered.setdefault(tokenizer_path, WordIds(tokenizer_path))
        for whole in batches:
            for batch in byte_slices(whole, "text", 2 << 20):
                texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
                rows: list[list] = [[], [], [], [], []]
                ids: list[np.ndarray] = []
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), words.encode(texts)):
                    total = len(raw) // 4
                    for start, length in cut(total, longest):
                        part = raw[4 * start : 4 * (start + length)]
                        for column, value in zip(rows, (doc_id, start, length, zlib.crc32(part), total)):
                            column.append(value)
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int64))
                arrays = [pa.array(c, pa.int64()) for c in rows]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(pieces, fields + (", ids array<long>" if with_ids else ""))
    bucket = F.log2("length").cast("int")
    # The id of a row leaves the five top bits free for the bucket.
    return out.withColumns(
        {
            "sequence_id": F.shiftleft(bucket.cast("long"), 59) + F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
            "bucket": bucket,
        }
    )
