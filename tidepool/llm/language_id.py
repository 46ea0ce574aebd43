"""Language identification by Bayesian fusion of four kinds of evidence.

* text: a naive Bayes model of hashed byte trigrams, counted over all
  documents of known language; the log-likelihood of a page's whole main blocks
  is divided by three, as neighbouring trigrams overlap;
* the language declared in the markup (``<html lang>``);
* the address: the first path segment that looks like a language code, else the
  last label of the host;
* the host: how its other pages read, smoothed towards its domain, which is
  smoothed towards all pages.

How far a declaration or an address can be trusted is learnt from the pages
themselves: each page's posterior by text alone is summed up by declared
language, by address, by host and by domain (grouped aggregation with partial
sums, so a hot host is no single task's work), which gives P(declared | language),
P(address | language) and the prior of a host. A page's own share is taken out
of its host's and domain's sums.

Null, empty and odd rows: documents without a text or a language are not learnt
from; a page without html has no text evidence and no declaration, one without
a url has neither address nor host (the empty host is a host like any other);
repeated rows are judged once each. Languages are ordered by name, and of equal
posteriors the first wins. Without documents to learn from the language is
null; an empty table of pages gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import byte_slices, cut_lineage, utf8_buffer
from tidepool.llm.html_template import Page, host_of

BUCKETS = 1 << 14
TRIGRAM_SHARE = 1 / 3
SMOOTH_TRIGRAM = 0.5
SMOOTH_EVIDENCE = 1.0
SMOOTH_DOMAIN = 20.0
SMOOTH_HOST = 10.0
BROADCAST_ROWS = 100_000

DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]{2,3})\b", re.I)
PATH_CODE = re.compile(r"//[^/?#]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?=[/?#]|$)")


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of every three consecutive bytes, A-Z lower-cased."""
    x = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    if len(x) < 3:
        return x[:0]
    return ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over the whole texts of documents of known language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                raw, offsets = utf8_buffer(batch.column("text"))
                for k, lang in enumerate(batch.column("lang").to_pylist()):
                    found = np.bincount(trigram_buckets(raw[offsets[k] : offsets[k + 1]]), minlength=BUCKETS)
                    seen[lang] = seen[lang] + found if lang in seen else found
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"]
            )

    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang is not null and text is not null"
    )
    return known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log P(bucket | language): at most 16,384 numbers a language."""
    rows = trigram_counts(docs).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.full((len(langs), BUCKETS), SMOOTH_TRIGRAM)
    place = {lang: k for k, lang in enumerate(langs)}
    counts[rows["lang"].map(place).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)] += rows["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)) if langs else counts


def address_of(url: str | None) -> str:
    """A language code in the path, else the host's last label."""
    m = PATH_CODE.search(url or "")
    return "/" + m[1].lower() if m else "." + host_of(url).rpartition(".")[2]


def domain_of(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def page_evidence(pages: DataFrame, model: np.ndarray) -> DataFrame:
    """page_id, url, host, domain, declared, address and the text's
    log-likelihood for each language."""
    names = ["page_id", "url", "host", "domain", "declared", "address", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "html"):
                out: list[list] = [[] for _ in names]
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    html = html or ""
                    page, host = Page(html), host_of(url)
                    text = "\n".join(t for at, t in page.blocks if not page.noise[at])
                    seen = np.bincount(trigram_buckets(np.frombuffer(text.encode(), np.uint8)), minlength=BUCKETS)
                    at = np.flatnonzero(seen)
                    likely = TRIGRAM_SHARE * (model[:, at] * seen[at]).sum(axis=1)
                    declared = DECLARED.search(html)
                    row = (page_id, url, host, domain_of(host), declared[1].lower() if declared else "", address_of(url), likely.tolist())
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = [pa.int64(), *[pa.string()] * 5, pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, host string, domain string, declared string, address string, text array<double>")


def normal(logs: list[Column]) -> Column:
    """Logarithms to probabilities that sum to 1."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return F.transform(
        F.array(F.transform(F.array(*logs), lambda x: F.exp(x - top))),
        lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)),
    )[0]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, url, lang, probability, text_lang (by the text alone), declared
    and address of each row of ``pages`` (page_id, url, html), learnt from
    ``docs`` (text, lang)."""
    langs, model = text_model(docs)
    n = len(langs)
    rows = page_evidence(pages, model)
    if not n:
        nothing = F.lit(None).cast("string")
        return rows.select("page_id", "url", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), nothing.alias("text_lang"), "declared", "address")
    rows = cut_lineage(rows.withColumn("by_text", normal([F.col("text")[k] for k in range(n)])))

    def sums(key: str | None) -> DataFrame:
        total = F.array(*(F.sum(F.col("by_text")[k]) for k in range(n)))
        name = key or "all"
        grouped = rows.groupBy(F.col(key).alias(f"{key}_key")) if key else rows.groupBy()
        return cut_lineage(grouped.agg(total.alias(f"{name}_sum")))

    every = [x or 0.0 for x in sums(None).first()["all_sum"]]
    total = sum(every)
    kinds = {}
    for key in ("host", "domain", "declared", "address"):
        found = sums(key)
        kinds[key] = found.count()
        rows = rows.join(F.broadcast(found) if kinds[key] <= BROADCAST_ROWS else found, F.col(key) == F.col(f"{key}_key"))

    def given(key: str, k: int) -> Column:
        """P(value | language k)."""
        return (F.col(f"{key}_sum")[k] + SMOOTH_EVIDENCE) / (every[k] + SMOOTH_EVIDENCE * kinds[key])

    def others(key: str, k: int) -> Column:
        """The key's sum without the page's own share."""
        return F.greatest(F.col(f"{key}_sum")[k] - F.col("by_text")[k], F.lit(0.0))

    def prior(k: int) -> Column:
        whole = (every[k] + 1.0) / (total + n)
        domain_total, host_total = (sum((others(key, j) for j in range(n)), F.lit(0.0)) for key in ("domain", "host"))
        domain = (others("domain", k) + SMOOTH_DOMAIN * whole) / (domain_total + SMOOTH_DOMAIN)
        return (others("host", k) + SMOOTH_HOST * domain) / (host_total + SMOOTH_HOST)

    fused = rows.withColumn(
        "fused",
        normal([F.col("text")[k] + F.log(given("declared", k)) + F.log(given("address", k)) + F.log(prior(k)) for k in range(n)]),
    )
    names = F.array(*map(F.lit, langs))
    best = F.array_max("fused")
    return fused.select(
        "page_id",
        "url",
        F.element_at(names, F.array_position("fused", best).cast("int")).alias("lang"),
        best.alias("probability"),
        F.element_at(names, F.array_position("by_text", F.array_max("by_text")).cast("int")).alias("text_lang"),
        "declared",
        "address",
    )
