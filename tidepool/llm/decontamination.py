"""Benchmark decontamination by winnowing, in DataFrame functions only.

A fingerprint is the smallest 6-gram hash of every 8 consecutive 6-grams, so
any 13 shared words share one. Three steps:

1. the fingerprints of documents meet those of the items; a broadcast is asked
   for only after the item side has been counted;
2. documents that share a fingerprint get the list of those they share, and
   each occurrence is extended to the 13-word windows that can hold it;
3. these windows are compared, word for word, with the windows of the items,
   and the covered words of a document are counted.

An item of fewer than 13 words is one window; as it need not hold a
fingerprint, documents are also searched for the grams of its length (at most
twelve lengths, those that occur).

Null, empty and odd rows: a null text has no words; a document or item without
words has no hit; a null doc_id is a document like any other, a null item_id
counts as an item but can't be listed; repeated document rows are reported
once each, repeated items count once. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage, text_key

WINDOW = 13
GRAM = 6
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The item side is broadcast up to this many rows, beyond that it is shuffled.
BROADCAST_ROWS = 200_000


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def positions(count: Column) -> Column:
    """1, 2 ... count; empty for a count under one."""
    return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(empty("int"))


def gram_hashes(words: Column, size: int) -> Column:
    """A hash for each run of ``size`` words, in order."""
    return F.transform(positions(F.size(words) - (size - 1)), lambda i: F.xxhash64(F.lit(size), F.slice(words, i, size)))


def winnow(words: Column, window: int, gram: int) -> Column:
    """The distinct smallest gram hashes of every ``window`` consecutive words."""
    grams = window - gram + 1
    return bind(
        gram_hashes(words, gram),
        lambda h: F.array_distinct(
            F.transform(positions(F.size(h) - (grams - 1)), lambda i: F.array_min(F.slice(h, i, grams)))
        ),
    )


def fingerprints(words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Winnowed hashes and, for short items, all grams of their lengths."""
    parts = [winnow(words, window, gram)] + [F.array_distinct(gram_hashes(words, n)) for n in short]
    return F.array_distinct(F.concat(*parts)) if short else parts[0]


def windows_at(words: Column, shared: Column, window: int, gram: int, short: list[int]) -> Column:
    """(start, length, words) of the windows that hold a shared fingerprint."""

    def text_at(i: Column, n: int) -> Column:
        return F.struct(
            i.alias("start"), F.lit(n).alias("length"), F.array_join(F.slice(words, i, n), " ").alias("window")
        )

    def long_ones(h: Column) -> Column:
        at = F.filter(positions(F.size(h)), lambda i: F.array_contains(shared, F.element_at(h, i)))
        around = F.flatten(F.transform(at, lambda i: F.sequence(i - (window - gram), i)))
        last = F.size(words) - (window - 1)
        return F.transform(
            F.filter(F.array_distinct(around), lambda i: (i >= 1) & (i <= last)), lambda i: text_at(i, window)
        )

    def short_ones(n: int):
        def of(h: Column) -> Column:
            at = F.filter(positions(F.size(h)), lambda i: F.array_contains(shared, F.element_at(h, i)))
            return F.transform(at, lambda i: text_at(i, n))

        return of

    parts = [bind(gram_hashes(words, gram), long_ones)] + [bind(gram_hashes(words, n), short_ones(n)) for n in short]
    return F.concat(*parts)


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if a count shows that it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def covered(spans: Column) -> Column:
    """Words covered by (start, length) spans."""
    start = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("total"))

    def add(seen: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        new = F.greatest(F.lit(0), end - F.greatest(span["start"], seen["until"]))
        return F.struct(F.greatest(seen["until"], end).alias("until"), (seen["total"] + new).alias("total"))

    return F.aggregate(F.array_sort(spans), start, add, lambda seen: seen["total"])


def report(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, row_key, n_words, copies (rows), n_hit, items and nulls (items
    without an id), for each distinct (doc_id, text)."""
    items = cut_lineage(
        benchmark.select(F.col("item_id"), words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    )
    length = F.least(F.size("words"), F.lit(window))
    short = sorted(r[0] for r in items.select(length.alias("n")).where(F.col("n") < window).distinct().collect())
    windows = items.select(
        "item_id",
        F.explode(
            F.transform(
                positions(F.size("words") - length + 1), lambda i: F.array_join(F.slice(F.col("words"), i, length), " ")
            )
        ).alias("item_window"),
        length.alias("item_length"),
    )
    windows = windows.groupBy("item_window", "item_length").agg(F.collect_set("item_id").alias("item_ids"), F.count_if(F.col("item_id").isNull()).alias("nulls"))
    item_prints = items.select(
        F.explode(
            F.when(F.size("words") >= window, winnow(F.col("words"), window, gram)).otherwise(
                F.array(F.xxhash64(F.size("words"), F.col("words")))
            )
        ).alias("item_print")
    ).distinct()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text").cast("string")).alias("row_key")
    )
    prints = rows.select(
        "doc_id",
        "row_key",
        F.explode(bind(words_of(F.col("text")), lambda w: fingerprints(w, window, gram, short))).alias("print"),
    )
    shared = (
        prints.join(small(item_prints), F.col("print") == F.col("item_print"), "left_semi")
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"))
        .agg(F.collect_set("print").alias("shared"))
    )
    met = rows.join(shared, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key")), "left")
    looked = met.select(
        "doc_id",
        "row_key",
        F.explode(
            F.transform(
                F.array(words_of(F.col("text"))),
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.when(F.col("shared").isNotNull(), windows_at(w, F.col("shared"), window, gram, short)).alias("found"),
                ),
            )
        ).alias("seen"),
    ).select("doc_id", "row_key", "seen.n_words", F.posexplode_outer("seen.found").alias("nth", "at"))
    at = looked.select("doc_id", "row_key", "n_words", "nth", "at.start", "at.length", "at.window")
    judged = at.join(
        small(windows), (F.col("window") == F.col("item_window")) & (F.col("length") == F.col("item_length")), "left"
    )
    hit = F.col("item_window").isNotNull()
    return judged.groupBy("doc_id", "row_key", "n_words").agg(
        F.count_if(F.col("nth").isNull() | (F.col("nth") == 0)).alias("copies"),
        covered(F.collect_set(F.when(hit, F.struct("start", "length")))).alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"),
        F.max(F.coalesce("nulls", F.lit(0))).alias("nulls"),
    )


def contaminated() -> Column:
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): how many words ``benchmark``
    (item_id, text) also holds, in windows of ``window`` words.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.
    """
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return (
        report(docs, benchmark, window, gram)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            (F.size("items") + F.when(F.col("nulls") > 0, 1).otherwise(0)).cast("long").alias("n_items"),
            F.sha2(names, 256).alias("items_sha256"),
            contaminated().alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with its columns, less the contaminated rows."""
    found = report(docs, benchmark, window, gram).where(contaminated())
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"))
    own = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text").cast("string")).alias("row_key"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key"))
    return own.join(gone, same, "left_anti").select("row.*")


def contamination_sql() -> str:
    """The same report in DuckDB SQL."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lowered = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lowered}, '{word}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({lowered}, '{word}') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS l, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p
        FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, l, p, array_to_string(w[p:p + l - 1], ' ') AS s
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
m AS (SELECT rid, p, dw.l, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.l = iw.l),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + l)) AS q FROM m) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""
