"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text. A text is compressed in windows of eight words, once with the ordinary
dictionary and once with that followed by the toxic one; a window's gain is
how many bytes the toxic dictionary saves. How many windows gain at least 2, 3,
4 or 6 bytes, alone and as a share, and the largest gain go into a logistic
model, which is the calibrated threshold.

What tells toxic text is rare in it, so the toxic dictionary is trained on the
pieces of toxic texts that stand out: strings of 5 to 12 bytes of a word that
are many times as frequent in toxic documents as in ordinary ones. Near copies
among the training rows count once, as a copied text would make all its words
look frequent.

The fit reads at most ``TRAIN_ROWS`` labelled rows (those whose id has the
smallest hash; it is broadcast by id, 16 bytes a row) and runs as one task. It
is cross-fitted: each quarter is scored with the dictionaries of the others to
calibrate, and the final dictionaries come from all. Every document is scored
over its whole text, where it is read; nothing is shuffled but the fit's rows.

Null, empty and odd rows: a null or empty text has no windows and gets the
model's score for that; a null doc_id counts as the empty string in the folds;
rows without a label, or with a null one, are not learnt from; if an id has
several labels the largest holds; an id that repeats is learnt from once for each
of its texts, within the ``TRAIN_ROWS``. With fewer than four toxic or four ordinary
rows to learn from, every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import byte_slices, crc_mod

TRAIN_ROWS = 12_000
WINDOW_WORDS = 8
ORDINARY_BYTES = 60_000
TOXIC_BYTES = 2_000
FOLDS = 4
GAINS = (2, 3, 4, 6)
PIECE_BYTES = range(5, 13)
STANDS_OUT = 20
LEVEL, MIN_MATCH = 9, 6
THRESHOLD = 0.3


def windows(text: bytes, words: int = WINDOW_WORDS) -> list[bytes]:
    """Consecutive windows over the whole text, lower-cased."""
    w = text.lower().split()
    return [b" " + b" ".join(w[i : i + words]) + b" " for i in range(0, len(w), words)]


def without_near_copies(texts: list[bytes]) -> list[bytes]:
    """Leaves out a text that shares an extreme 4-word shingle hash with one before."""
    seen, kept = set(), []
    for t in texts:
        w = t.split()
        hashes = [zlib.crc32(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))]
        marks = {(m, min(h ^ m for h in hashes)) for m in (0, 0xFFFFFFFF, 0x5BD1E995, 0xA5A5A5A5)}
        if not marks & seen:
            kept.append(t)
        seen |= marks
    return kept


def pieces(word: bytes) -> set[bytes]:
    w = b" " + word
    return {w[a : a + n] for n in PIECE_BYTES for a in range(len(w) - n + 1)}


def piece_counts(texts: list[bytes], of: set[bytes] | None = None) -> Counter:
    """In how many (text, word) pairs each piece (``of`` these) stands."""
    words = Counter(w for t in texts for w in set(t.split()))
    least = PIECE_BYTES[0]
    cores = None if of is None else {p[a : a + least] for p in of for a in range(len(p) - least + 1)}
    counts: Counter = Counter()
    for word, n in words.items():
        if cores is None:
            found = pieces(word)
        else:  # a word without any of their shortest parts has none of the pieces
            w = b" " + word
            found = pieces(word) & of if any(w[a : a + least] in cores for a in range(len(w) - least + 1)) else ()
        for p in found:
            counts[p] += n
    return counts


def standing_out(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    often = piece_counts(toxic)
    often = {p: n for p, n in often.items() if n >= max(3, len(toxic) // 200)}
    there = piece_counts(ordinary, set(often))
    scale = len(ordinary) / len(toxic)
    return {p for p, n in often.items() if n * scale >= STANDS_OUT * (there[p] + 1)}


def train(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; of too few samples, their end."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
        # What follows the entropy tables is text; they end in three repeat offsets 1, 4, 8.
        tables = trained.find(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")
        return trained[tables + 12 :] if tables >= 0 else trained
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    toxic, ordinary = (without_near_copies([t.lower() for t in ts]) for ts in (toxic, ordinary))
    found = standing_out(toxic, ordinary)
    samples = []
    for t in toxic:
        parts = []
        for w in t.split():
            own = [(w_at, w_at + len(p)) for p in pieces(w) & found for w_at in [(b" " + w).find(p)]]
            if own:
                parts.append((b" " + w)[min(a for a, _ in own) : max(b for _, b in own)])
        if parts:
            samples.append(b"".join(parts) + b" ")
    plain = [w for t in ordinary for w in windows(t, 2 * WINDOW_WORDS)]
    return train(plain, ORDINARY_BYTES), train(samples, TOXIC_BYTES) if samples else b""


class Distance:
    """Bytes that the toxic dictionary saves in each window of a text."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            dict_size=len(ordinary) + len(toxic),
            min_match=MIN_MATCH,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )

        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress

        ordinary = ordinary or b" " * 8
        self.plain, self.both = compressor(ordinary), compressor(ordinary + toxic)

    def features(self, text: bytes) -> list[float]:
        plain, both = self.plain, self.both
        gains = np.array([len(plain(w)) - len(both(w)) for w in windows(text)] or [0])
        over = [int((gains >= g).sum()) for g in GAINS]
        n = len(gains)
        return [float(gains.max()), *(k / n for k in over), *(float(np.log1p(k)) for k in over), float(np.log1p(n))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> dict:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "weights": w}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    # Summed row by row: a matrix product may round a row by its batch.
    z = (np.c_[(x - model["mean"]) / model["scale"], np.ones(len(x))] * model["weights"]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], toxic: np.ndarray) -> dict | None:
    """Dictionaries and calibration; None if a class is missing from a fold."""
    fold = np.zeros(len(texts), np.int64)
    for c in (0, 1):  # each class is dealt evenly
        own = np.flatnonzero(toxic == c)
        if len(own) < FOLDS:
            return None
        fold[own] = np.arange(len(own)) % FOLDS

    def dictionaries(rows: np.ndarray) -> tuple[bytes, bytes]:
        split = {c: [texts[i] for i in np.flatnonzero(rows & (toxic == c))] for c in (0, 1)}
        return train_dictionaries(split[1], split[0])

    x = np.zeros((len(texts), len(GAINS) * 2 + 2))
    for k in range(FOLDS):
        distance = Distance(*dictionaries(fold != k))
        for i in np.flatnonzero(fold == k):
            x[i] = distance.features(texts[i])
    ordinary, peculiar = dictionaries(fold >= 0)
    return fit_logistic(x, toxic) | {"ordinary": ordinary, "toxic": peculiar}


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, text and toxic of at most ``train_rows`` rows of at most as many
    labelled ids outside the held-out fold, chosen by hash."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text is not null")
    rows = own.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic").distinct()
    # Ordered by digests: sort keys are sampled at the driver, which texts would grow with.
    return rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", F.md5("text")).limit(train_rows)


def fit_on(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict | None:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        model = fit([t.encode() for t in rows["text"]], rows["toxic"].to_numpy(np.int64))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    rows = training_rows(docs, labels, train_rows).withColumn("fit", F.col("toxic") * 0)
    rows = rows.groupBy("fit").applyInPandas(run, "model binary")
    found = rows.collect()  # one row of some 70 kB, or none
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id,
    text), learnt from ``labels`` (doc_id, toxic)."""
    model = fit_on(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model["ordinary"], model["toxic"]) if model else None
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
                p = probability(model, np.array([distance.features(t) for t in texts])) if model else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with its columns, less the rows that are predicted to be toxic."""
    model = fit_on(docs, labels, train_rows)
    if not model:
        return docs

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        distance = Distance(model["ordinary"], model["toxic"])
        for batch in texts:
            x = [distance.features(t.encode() if t else b"") for t in batch]
            yield pd.Series(probability(model, np.array(x)) if x else [], dtype="float64")

    return docs.where(of(F.col("text").cast("string")) < THRESHOLD)
