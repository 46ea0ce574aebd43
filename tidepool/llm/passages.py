"""What substring and suffix-array dedup share: which windows of which texts
need to be compared, and where.

A text is a sequence of values (words or bytes). Equal windows select the same
gram (``winnow``), so a window is only compared with windows of the same
choice. Consecutive windows with one choice are a unit; a choice that no other
place shares is dropped before anything else is shuffled. Equal units collapse
to one content, kept once with its smallest holder; only contents travel on,
as text, to be compared in groups of one choice.

A choice with more than ``FULL`` contents (a line that stands in very many
different surroundings) is not compared in one group: its contents are searched
anew with a longer gram, which parts them by what surrounds the line.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import winnow
from tidepool.llm.common import byte_slices, give_back, text_key, utf8_buffer, word_bounds
from tidepool.session import ensure_checkpoint_dir

FULL = 512
SLICE_BYTES = 512 << 10


@dataclass(frozen=True)
class Kind:
    """What a value is, how many make a window and how many a gram."""

    name: str
    window: int
    gram: int

    def values(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start byte, end byte, text) of each value."""
        if self.name == "bytes":
            at = np.arange(len(raw))
            return winnow.BYTE_VALUES[raw], at, at + 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        start, end, row = word_bounds(raw, offsets)
        return winnow.PrefixHash(winnow.BYTE_VALUES[raw]).spans(start, end), start, end, row

    def parts(self, body: bytes) -> list[bytes] | bytes:
        """The values of one text, to be sliced."""
        return body if self.name == "bytes" else body.split()

    def join(self, parts) -> bytes:
        return parts if self.name == "bytes" else b" ".join(parts)


def stage_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back:
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, text: rows that share a doc_id differ in row_key,
    repeated rows share it."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("row_key"), text.alias("text"))


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: lists as Python objects take many times their size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def packed(rows: DataFrame) -> DataFrame:
    """doc_id, row_key and the text compressed: half the shuffle of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in (part for whole in batches for part in byte_slices(whole, "text")):
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            body = pa.array([squeeze.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), body], ["doc_id", "row_key", "body"])
        give_back()

    return rows.mapInArrow(run, "doc_id long, row_key long, body binary")


def same_row(a: str, b: str) -> Column:
    return (F.col(f"{a}.row_key") == F.col(f"{b}.row_key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def unit_rows(rows: DataFrame, kind: Kind) -> DataFrame:
    """choice, content, doc_id, row_key and place of every unit. place holds
    the first window's start, how many windows follow and where the gram is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                values, _, _, text = kind.values(*utf8_buffer(batch.column("text")))
                choice, content, first, last, at, _ = winnow.units(values, text, kind.window, kind.gram)
                row = text[first] if len(first) else first
                base = np.searchsorted(text, row)
                place = (first - base) << 16 | (last - first) << 8 | (at - first)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(choice.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        batch.column("doc_id").take(take),
                        batch.column("row_key").take(take),
                        pa.array(place),
                    ],
                    ["choice", "content", "doc_id", "row_key", "place"],
                )
        give_back()

    if kind.window - kind.gram > 255:
        raise ValueError("a unit's place has room for 255 windows")
    return rows.mapInArrow(run, "choice long, content long, doc_id long, row_key long, place long")


def shared_units(rows: DataFrame, kind: Kind, shared: Column, aggregates: list[Column]) -> DataFrame:
    """Units whose choice stands in more than one place, as ``shared`` judges
    ``aggregates`` over the units of a choice."""
    units = unit_rows(rows, kind)
    # Written first, so that the join has two plain sides and a hot choice can be split.
    common = stage_table(units.groupBy(F.col("choice").alias("met")).agg(*aggregates).where(shared).select("met"))
    return stage_table(units.join(common, F.col("choice") == F.col("met"), "left_semi"))


def contents_of(units: DataFrame) -> DataFrame:
    """choice, content, how many units have it (n), its smallest holder, and how
    many contents its choice has."""
    holder = F.min(F.struct("doc_id", "row_key", "place"))
    contents = stage_table(
        units.groupBy("choice", "content").agg(F.count("*").alias("n"), holder.alias("holder"))
    )
    many = contents.groupBy(F.col("choice").alias("met")).agg(F.count("*").alias("contents")).where("contents > 1")
    return contents.join(many, F.col("choice") == F.col("met"), "left").select(
        "choice", "content", "n", "holder", F.coalesce("contents", F.lit(1)).cast("long").alias("contents")
    )


def with_text(contents: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each holder's text with the list of the contents to cut from it."""
    wanted = contents.groupBy("holder.doc_id", "holder.row_key").agg(
        F.collect_list(F.struct("choice", "content", "n", F.col("holder.place").alias("place"))).alias("wanted")
    )
    return (
        bodies.alias("b").join(wanted.alias("w"), same_row("b", "w")).select("b.doc_id", "b.row_key", "b.body", "w.wanted")
    )


def cut_texts(held: DataFrame, kind: Kind) -> DataFrame:
    """choice, content, n, owner, lead (values before the gram) and the text of
    each content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in few_rows(batches):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, body, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "wanted"))):
                parts = kind.parts(open_up.decompress(body))
                for w in wanted:
                    first, more, lead = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    text = kind.join(parts[first : first + more + kind.window])
                    for column, value in zip(out, (w["choice"], w["content"], w["n"], doc_id, lead, text)):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["choice", "content", "n", "owner", "lead", "text"])
        give_back()

    return held.mapInArrow(run, "choice long, content long, n long, owner long, lead long, text binary")


SPANS = "array<struct<from:long,until:long>>"


@dataclass(frozen=True)
class Rule:
    """When something repeats.

    ``aggregates`` over the units of a choice, and ``shared`` judging them, say
    which choices can matter at all. ``compare`` takes the texts of the contents
    that ``compared`` holds of, and about how many there are, and returns
    choice, content and the runs of windows (from, until) of the content's
    smallest holder that repeat. Any other unit repeats as a whole where
    ``whole`` holds of its doc_id, its content's owner and n.
    """

    aggregates: list[Column]
    shared: Column
    compared: Column
    compare: Callable[[DataFrame, int], DataFrame]
    whole: Column


def within_full(texts: DataFrame, kind: Kind, rule: Rule) -> DataFrame:
    """The same as ``compare`` for choices with many contents: each content is
    a text of its own - it holds exactly its unit's windows - and these texts
    are searched anew with a longer gram. A gram as long as the window leaves
    one content to a choice, so this ends."""
    texts = stage_table(texts.withColumn("row_key", F.xxhash64("choice", "content")))
    rows = texts.select(F.col("owner").alias("doc_id"), "row_key", "text")
    finer = Kind(kind.name, kind.window, (kind.gram + kind.window + 1) // 2)
    gone = removed_spans(rows, packed(rows), finer, rule)
    windows = F.transform(
        "g.gone", lambda s: F.struct(s["from"].alias("from"), (s["until"] - (kind.window - 1)).alias("until"))
    )
    named = texts.withColumnRenamed("owner", "doc_id")
    return named.alias("b").join(gone.alias("g"), same_row("b", "g")).select(
        "b.choice", "b.content", windows.cast(SPANS).alias("spans")
    )


def removed_spans(rows: DataFrame, bodies: DataFrame, kind: Kind, rule: Rule) -> DataFrame:
    """doc_id, row_key and the spans of values to remove (gone) of ``rows``
    (doc_id, row_key, text), whose texts ``bodies`` has packed."""
    units = shared_units(rows, kind, rule.shared, rule.aggregates)
    contents = contents_of(units)
    few = F.col("contents") <= FULL
    found = rule.compare(cut_texts(with_text(contents.where(rule.compared & few), bodies), kind), units.count())
    full = contents.where(~few)
    if not full.isEmpty():
        found = found.unionByName(within_full(cut_texts(with_text(full, bodies), kind), kind, rule))
    known = contents.select("choice", "content", "n", F.col("holder.doc_id").alias("owner"))
    verdict = stage_table(
        known.unionByName(found, allowMissingColumns=True)
        .groupBy(F.col("choice").alias("c"), F.col("content").alias("t"))
        .agg(F.max("n").alias("n"), F.max("owner").alias("owner"), F.first("spans", ignorenulls=True).alias("spans"))
    )
    first, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = F.array(F.struct(first.alias("from"), (first + more + kind.window).alias("until"))).cast(SPANS)
    some = F.transform(
        "spans", lambda s: F.struct((first + s["from"]).alias("from"), (first + s["until"] + (kind.window - 1)).alias("until"))
    ).cast(SPANS)
    return (
        units.join(verdict, (F.col("choice") == F.col("c")) & (F.col("content") == F.col("t")))
        .withColumn("gone", F.when(rule.whole, whole).otherwise(some))
        .where("gone is not null")
        .groupBy("doc_id", "row_key")
        .agg(F.flatten(F.collect_list("gone")).alias("gone"))
    )


def keep_mask(n: int, spans) -> np.ndarray:
    """True for the values that no span covers."""
    depth = np.zeros(n + 1, np.int64)
    for s in spans:
        depth[s["from"]] += 1
        depth[s["until"]] -= 1
    return np.cumsum(depth[:n]) == 0


def map_kept(bodies: DataFrame, gone: DataFrame, row_of: Callable, names: list[str], schema: str) -> DataFrame:
    """One row for each text: doc_id and what ``row_of(text, spans)`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        fields = None
        for batch in few_rows(batches):
            rows = [row_of(open_up.decompress(b), s) for b, s in zip(batch.column("body").to_pylist(), batch.column("gone").to_pylist())]
            columns = list(zip(*rows)) or [()] * len(names)
            fields = fields or [pa.string() if f"{n} string" in schema else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, fields)], ["doc_id", *names]
            )
        give_back()

    met = bodies.alias("b").join(gone.alias("g"), same_row("b", "g"), "left").select("b.doc_id", "b.body", "g.gone")
    return met.mapInArrow(run, schema)
