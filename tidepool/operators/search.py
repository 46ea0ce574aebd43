"""Retrieval over text and vector tables: tokens, keyword top-k through an
inverted index, cosine top-k, reciprocal rank fusion, page focus, and exact
passage lookup through a word-4-gram filter.

No query is compared with every document: keyword scoring joins query terms
to document terms on the term; passage lookup joins on one 4-gram of the
passage and verifies candidates; vector queries are a small, size-checked
set applied as a constant array to each corpus row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import (  # noqa: F401 - re-exported for callers of the search operators
    STEM_SUFFIXES,
    STOPWORDS,
    SYNONYMS,
    distinct_tokens,
    hashed,
    hashed_grams,
    page_focus,
    query_terms,
    raw_words,
    stem,
    tokens,
    word_grams,
    words_of,
)
from tidepool.functions.vectors import dot, unit
from tidepool.operators.termscore import term_scores

VECTOR_BLOCK = 256


def document_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms): the distinct tokens of each id's texts, sorted, one row per id.
    They are made distinct where a text is read; what is shuffled is one array per
    text, not a row per token."""
    own = df.select(F.col(id_col), distinct_tokens(F.col(text_col)).alias("__own"))
    per = own.groupBy(id_col).agg(F.collect_list("__own").alias("__all"))
    return per.select(id_col, F.sort_array(F.when(F.size("__all") == 1, F.get("__all", 0)).otherwise(F.array_distinct(F.flatten("__all")))).alias("terms"))


def keyword_scores(queries: DataFrame, docs: DataFrame, qid: str, did: str, fields: Sequence[tuple[str, int]], best: int | None = None) -> DataFrame:
    """Score = sum over fields of weight x |query terms & field terms|,
    through an inverted index of the queries (``term_scores``): a field's tokens are
    made distinct where the document is read, and its scores are summed where it is.
    With ``best`` at least each query's ``best`` documents, by score and id."""
    q = _asked_terms(queries, qid).withColumn("n", F.size("terms"))
    own = docs.select(F.col(did).alias("d"), F.array(*[distinct_tokens(F.col(c)) for c, _ in fields]).alias("terms"))
    return term_scores(q, own, [w for _, w in fields], best)


def overlap_scores(queries: DataFrame, docs: DataFrame, qid: str, did: str, best: int | None = None) -> DataFrame:
    """(q, d, jac): Jaccard overlap of the terms of queries and of documents (both
    with ``terms``, documents one row an id). With ``best`` at least each query's
    ``best`` documents, by overlap and id."""
    own = queries.select(F.col(qid).alias("q"), F.size("terms").alias("n"))
    q = _asked_terms(queries, qid).join(own, "q")
    s = term_scores(q, docs.select(F.col(did).alias("d"), F.array("terms").alias("terms")), [1], best, jaccard=True)
    return s.withColumnRenamed("score", "jac")


def _asked_terms(queries: DataFrame, qid: str) -> DataFrame:
    """(q, terms): the distinct terms of each id's queries that have any."""
    q = queries.select(F.col(qid).alias("q"), "terms").filter(F.size("terms") > 0)
    return q.groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def top_k(scored: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` rows per group by ``order`` (row_number <= k; Spark applies
    the limit per partition before the shuffle)."""
    w = Window.partitionBy(group).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean unit vector per key (per-dimension averages, partial aggregation)."""
    e = vectors.select(key, F.posexplode(unit(F.col(vec))).alias("i", "x"))
    per = e.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(
        key, F.transform("s", lambda s: s["x"]).alias(vec)
    )


def cosine_topk(corpus: DataFrame, cid: str, vec: str, queries: DataFrame, qid: str, qvec: str, k: int) -> DataFrame:
    """Exact top-k by cosine for any number of queries. The queries are dealt
    into blocks of about ``VECTOR_BLOCK``, one row each; every corpus row meets
    every block, and Spark keeps each partition's k best before the shuffle."""
    blocks = max(1, -(-queries.count() // VECTOR_BLOCK))
    asked = queries.select(F.struct(F.col(qid).alias("q"), unit(F.col(qvec)).alias("u")).alias("one"), F.pmod(F.xxhash64(qid), F.lit(blocks)).alias("block"))
    asked = asked.groupBy("block").agg(F.collect_list("one").alias("some"))
    c = corpus.select(F.col(cid).alias("d"), unit(F.col(vec)).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    sims = c.join(asked, "block").select("d", F.explode(F.transform("some", lambda q: F.struct(q["q"].alias("q"), dot(q["u"], F.col("v")).alias("sim")))).alias("s"))
    scored = sims.select(F.col("s.q").alias("q"), "d", F.col("s.sim").alias("sim"))
    return top_k(scored, "q", [F.desc("sim"), F.asc("d")], k)


def rrf(lists: Sequence[DataFrame], group: str, item: str, k_const: int = 60, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k_const + rank) over the ranked
    lists (each with ``rank``), then top ``k`` per group (ties by item)."""
    u = None
    for df in lists:
        s = df.select(group, item, (1.0 / (k_const + F.col("rank"))).alias("rr"))
        u = s if u is None else u.unionByName(s)
    fused = u.groupBy(group, item).agg(F.sum("rr").alias("fused"))
    return top_k(fused, group, [F.desc("fused"), F.asc(item)], k)


def _char_grams(word: Column) -> Column:
    """The distinct runs of one, two and three characters of a word."""
    starts = F.sequence(F.lit(1), F.length(word))

    def runs(n: int) -> Column:
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


def _short_candidates(short: DataFrame, words: DataFrame) -> DataFrame:
    """(p, pt, d) for passages of one or two words, which a document may cut on
    both sides: their longer word stands inside a word of the document. The
    distinct words of all documents are searched by runs of characters, and
    documents are reached through the words found."""
    held = words.select("d", F.explode(F.array_distinct("w")).alias("word"))
    grams = held.select("word").distinct().select("word", F.explode(_char_grams(F.col("word"))).alias("gram"))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    asked = short.select("p", "pt", longest.alias("own"))
    asked = asked.withColumn("gram", F.substring("own", F.lit(1), F.least(F.lit(3), F.length("own"))))
    found = asked.join(grams, "gram").filter(F.contains("word", "own")).select("p", "pt", "word")
    return found.join(held, "word").select("p", "pt", "d")


def passage_hits(passages: DataFrame, pid: str, ptext: str, docs: DataFrame, did: str, dtext: str, n: int = 4) -> DataFrame:
    """(passage, doc) where the doc contains the whole passage text.

    A contained passage's interior words (all but the first and last, which
    may be cut mid-word) occur in the doc as whole whitespace words, and so do
    its interior word n-grams. Each passage is keyed by one interior n-gram
    (or, with fewer than n + 2 words, one interior word) - the smallest hash -
    and joined to the docs' n-gram / word index, which holds hashes too. Passages
    of one or two words have no interior and are found through the documents'
    vocabulary, which is searched only if there are any. Candidates, those by a
    chance equality of hashes among them, are verified with ``contains``. A passage
    without a word is no passage.
    """
    pw = passages.select(F.col(pid).alias("p"), F.col(ptext).alias("pt")).withColumn("w", words_of(F.col("pt")))
    inner = pw.filter(F.size("w") >= 3).select("p", "pt", hashed(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))).alias("h"))
    grams = F.when(F.size("h") >= n, hashed_grams(F.col("h"), n)).otherwise(F.col("h"))
    keyed = inner.select("p", "pt", F.array_min(grams).alias("gram"))
    d = docs.select(F.col(did).alias("d"), F.col(dtext).alias("dt"))
    dw = d.select("d", words_of(F.col("dt")).alias("w"))
    dh = dw.select("d", hashed(F.col("w")).alias("h"))
    index = dh.select("d", F.explode(F.array_distinct(F.concat(hashed_grams(F.col("h"), n), F.col("h")))).alias("gram"))
    cand = keyed.join(index, "gram").select("p", "pt", "d")
    short = pw.filter((F.size("w") >= 1) & (F.size("w") <= 2))
    if not short.isEmpty():
        cand = cand.unionByName(_short_candidates(short, dw))
    full = cand.distinct().join(d, "d")
    return full.filter(F.contains(F.col("dt"), F.col("pt"))).select(F.col("p").alias(pid), F.col("d").alias(did))
