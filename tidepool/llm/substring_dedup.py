"""Substring dedup with suffix automata of reference shards.

The reference of a document is every document with a smaller doc_id. A passage
of 50 words or more can only be in both where both select the same gram
(``passages``), so the reference is cut into contents that more than one
document may hold, and dealt into shards by that choice. Each shard becomes one
suffix automaton over its words, whose states know the smallest doc_id that
holds them; the passages dealt to the shard are streamed through it. The
matching statistic at each word, cut at 50, leads to the state of the last 50
words and with it to the smallest document that holds them: where that one is
smaller than the document's own id, the window goes. Equal passages of many
documents are streamed once, and the outcome is read for each of them.

A shard has a bounded number of words, the words of one choice are bounded
(``passages.FULL``), and an automaton lives in the task of its shard alone: it
goes to no other.

Null, empty and odd rows: a null text has no words; a row with a null doc_id
keeps all its words and takes none from others (null is neither smaller nor
larger); rows that share a doc_id, repeated ones included, take no words from
each other; texts under 50 words are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import give_back, text_key
from tidepool.llm.passages import SPANS, Kind, Rule, few_rows, keep_mask, keyed, map_kept, packed, removed_spans, same_row

WINDOW = 50
GRAM = 16
SHARD_WORDS = 60_000


#: Larger than any owner: no sequence seen yet.
NOBODY = (1 << 63) - 1


class SuffixAutomaton:
    """The suffix automaton of several word sequences; a state knows the
    smallest owner of the sequences it occurs in.

    States are rows of flat arrays (28 bytes). Nearly all have one transition,
    which stands in ``symbol`` and ``target``; only states with more have a
    dictionary for the others."""

    def __init__(self):
        self.symbol = array("i", [-1])
        self.target = array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link = array("i", [-1])
        self.length = array("i", [0])
        self.owner = array("q", [NOBODY])

    def _state(self, length: int, link: int) -> int:
        self.symbol.append(-1)
        self.target.append(0)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(NOBODY)
        return len(self.link) - 1

    def step(self, v: int, c: int) -> int:
        """Where ``c`` leads from state ``v``; 0, the root, if nowhere."""
        if self.symbol[v] == c:
            return self.target[v]
        others = self.more.get(v)
        return others.get(c, 0) if others else 0

    def _lead(self, v: int, c: int, to: int) -> None:
        if self.symbol[v] in (-1, c):
            self.symbol[v], self.target[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _clone(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q])
        self.symbol[clone], self.target[clone] = self.symbol[q], self.target[q]
        if q in self.more:
            self.more[clone] = self.more[q].copy()
        self.link[q] = clone
        while p >= 0 and self.step(p, c) == q:
            self._lead(p, c, clone)
            p = self.link[p]
        return clone

    def add(self, sequence, owner: int) -> None:
        link, length, owners, step = self.link, self.length, self.owner, self.step
        last = 0
        for c in sequence:
            q = step(last, c)
            if q:  # the sequence so far is there already
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
            else:
                state, p = self._state(length[last] + 1, 0), last
                while p >= 0 and not step(p, c):
                    self._lead(p, c, state)
                    p = link[p]
                if p >= 0:
                    q = step(p, c)
                    link[state] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = state
            if owner < owners[last]:
                owners[last] = owner

    def finish(self) -> None:
        """Carry each state's smallest owner up the suffix links."""
        link, owners = self.link, self.owner
        for v in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[:0:-1].tolist():
            u = link[v]
            if u > 0 and owners[v] < owners[u]:
                owners[u] = owners[v]

    def owners_of(self, sequence, window: int) -> list[int | None]:
        """The smallest owner of each window of ``sequence``, None for windows
        that no sequence holds: the matching statistic is kept at ``window``."""
        link, length, owners, step = self.link, self.length, self.owner, self.step
        v, matched, out = 0, 0, []
        for i, c in enumerate(sequence):
            to = step(v, c)
            while v and not to:
                v = link[v]
                matched = length[v]
                to = step(v, c)
            if to:
                v = to
                matched += 1
            while v and length[link[v]] >= window:
                v = link[v]
            matched = min(matched, length[v])
            if i + 1 >= window:
                out.append(owners[v] if matched >= window else None)
        return out


def shard_spans(shard: pd.DataFrame, window: int) -> pd.DataFrame:
    """Of each content of a shard the runs of windows that a smaller document
    than the content's own holds."""
    shard = shard.drop_duplicates(["choice", "content"])
    ids: dict[bytes, int] = {}
    words = [array("i", [ids.setdefault(w, len(ids)) for w in t.split(b" ")]) for t in shard["text"]]
    owners = shard["owner"].tolist()
    out = shard[["choice", "content"]]
    del ids, shard  # the automaton is what the task has room for
    automaton = SuffixAutomaton()
    for sequence, owner in zip(words, owners):
        automaton.add(sequence, owner)
    automaton.finish()
    spans = []
    for sequence, owner in zip(words, owners):
        runs: list[dict] = []
        for i, least in enumerate(automaton.owners_of(sequence, window)):
            if least is not None and least < owner:
                if runs and runs[-1]["until"] == i:
                    runs[-1]["until"] = i + 1
                else:
                    runs.append({"from": i, "until": i + 1})
        spans.append(runs)
    out = out.assign(spans=spans)
    return out[out["spans"].map(len) > 0]


def smaller_holder(window: int, gram: int) -> Rule:
    """A window repeats where a document with a smaller doc_id holds it."""

    def compare(texts: DataFrame, units: int) -> DataFrame:
        shards = max(1, -(-units * (window + (window - gram) // 2) // SHARD_WORDS))
        dealt = texts.withColumn("shard", F.pmod(F.xxhash64("choice"), F.lit(shards)))
        return dealt.groupBy("shard").applyInPandas(
            lambda shard: shard_spans(shard, window), f"choice long, content long, spans {SPANS}"
        )

    return Rule(
        aggregates=[F.min("doc_id").alias("low"), F.max("doc_id").alias("high")],
        shared=F.col("low") < F.col("high"),
        compared=F.lit(True),
        compare=compare,
        whole=F.col("doc_id") > F.col("owner"),
    )


def spans_held_before(rows: DataFrame, bodies: DataFrame, window: int, gram: int) -> DataFrame:
    return removed_spans(rows.where("doc_id is not null"), bodies, Kind("words", window, gram), smaller_holder(window, gram))


def kept_words(text: bytes, spans) -> tuple[int, list[bytes]]:
    words = text.split()
    if spans is None or not len(spans):
        return len(words), words
    return len(words), [w for w, k in zip(words, keep_mask(len(words), spans)) if k]


def digest_row(text: bytes, spans) -> tuple[int, int, str]:
    n, kept = kept_words(text, spans)
    return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of ``docs``
    (doc_id, text), after removing every word covered by a window of ``window``
    words that also starts in a document with a smaller doc_id."""
    rows = keyed(docs)
    bodies = packed(rows)
    gone = spans_held_before(rows, bodies, window, gram)
    return map_kept(
        bodies, gone, digest_row, ["n_words", "n_removed", "kept_sha256"], "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


#: Beside the columns of the documents, whatever they are called.
GONE = "__spans_to_remove__"


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with its columns, ``text`` holding the words that stay, joined
    by one space; texts that lose no word are left as they are. Rows pass
    through Python few at a time, and only texts that lose words are read."""
    names = docs.columns
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            columns, gone = batch.columns[:-1], batch.column(batch.num_columns - 1)
            hit = pc.indices_nonzero(gone.is_valid())
            if len(hit):
                texts = columns[at].to_pylist()
                for i, spans in zip(hit.to_pylist(), gone.take(hit).to_pylist()):
                    if texts[i] is not None:
                        texts[i] = b" ".join(kept_words(texts[i].encode(), spans)[1]).decode()
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    rows = keyed(docs)
    gone = spans_held_before(rows, packed(rows), window, gram)
    own = docs.select(
        F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("row_key")
    )
    met = own.alias("b").join(gone.alias("g"), same_row("b", "g"), "left")
    return met.select(*(F.col(f"b.row.{c}").alias(c) for c in names), F.col("g.gone").alias(GONE)).mapInArrow(cut, docs.schema)


def substring_dedup_sql() -> str:
    """The same in DuckDB SQL."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
v AS (
  SELECT rid, doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
o AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
gone AS (
  SELECT rid, list(DISTINCT q) AS g
  FROM (SELECT rid, unnest(range(p, p + {WINDOW})) AS q FROM v JOIN o USING (h) WHERE least < doc_id) GROUP BY rid),
k AS (
  SELECT d.rid, string_agg(w[q], ' ' ORDER BY q) AS kept, count(*) AS n
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS q FROM d) d
  LEFT JOIN (SELECT rid, unnest(g) AS q FROM gone) x USING (rid, q) WHERE x.rid IS NULL GROUP BY d.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""
