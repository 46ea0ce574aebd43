"""Catalog queries: tokens, keyword / vector / fused retrieval over the
text tables, retrieval scoring against exact passage matches, and result
reconciliation.

Documents play catalog pages: title = first line, description = second
line, detection = the remaining lines. Benchmark items play the questions;
an item's expected pages are the documents that contain its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import evaluate as E
from tidepool.operators import search as SR
from tidepool.plans import governance as GOV
from tidepool.plans.registry import query
from tidepool.session import cut_lineage
from tidepool.sources.tables import read_table

DEPTH, TOPK, FLOOR = 20, 5, 0.05


def documents(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lines = F.col("lines")
    return d.select("doc_id", "text", F.split("text", "\n").alias("lines")).select(
        "doc_id", "text",
        F.try_element_at(lines, F.lit(1)).alias("title"),
        F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("description"),
        F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(1))), "\n").alias("detect"),
    )


def questions(spark, sf_dir) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return b.select("item_id", "text", SR.query_terms(F.col("text")).alias("terms"))


def keyword_ranked(spark, sf_dir, depth: int) -> DataFrame:
    s = SR.keyword_scores(questions(spark, sf_dir), documents(spark, sf_dir), "item_id", "doc_id",
                          [("title", 3), ("description", 2), ("detect", 1)], depth)
    return SR.top_k(s.filter("score > 0"), "q", [F.desc("score"), F.asc("d")], depth)


def overlap_ranked(spark, sf_dir, depth: int) -> DataFrame:
    """Second ranking: Jaccard overlap of question terms and document terms."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).filter("doc_id IS NOT NULL")
    j = SR.overlap_scores(questions(spark, sf_dir), SR.document_terms(d, "doc_id", "text"), "item_id", "doc_id", depth)
    return SR.top_k(j, "q", [F.desc("jac"), F.asc("d")], depth)


def fused(kw: DataFrame, ov: DataFrame) -> DataFrame:
    best = ov.groupBy("q").agg(F.max("jac").alias("best"))
    ov_ok = ov.join(best.filter(F.col("best") >= FLOOR), "q", "left_semi")
    return SR.rrf([kw.select("q", "d", "rank"), ov_ok.select("q", "d", "rank")], "q", "d", k=TOPK)


# --- SQL twins -----------------------------------------------------------------
def _tokens_sql(t: str) -> str:
    stop = "[" + ", ".join(f"'{s}'" for s in SR.STOPWORDS) + "]"
    stem = "CASE " + " ".join(
        f"WHEN length(x) > {len(s) + 3} AND ends_with(x, '{s}') THEN left(x, length(x) - {len(s)})" for s in SR.STEM_SUFFIXES
    ) + " ELSE x END"
    parts = (
        f"flatten(list_transform(regexp_extract_all(lower({t}), '[a-z0-9_]+'), lambda w: CASE WHEN contains(w, '_') "
        f"THEN list_concat([w], list_filter(string_split(w, '_'), lambda p: p <> '')) ELSE [w] END))"
    )
    return f"list_transform(list_filter({parts}, lambda y: length(y) >= 2 AND NOT list_contains({stop}, y)), lambda x: {stem})"


def _qterms_sql(t: str) -> str:
    case = "CASE w " + " ".join(f"WHEN '{k}' THEN '{' '.join(v)}'" for k, v in SR.SYNONYMS.items()) + " ELSE '' END"
    extra = f"array_to_string(list_transform(regexp_extract_all(lower({t}), '[a-z0-9_]+'), lambda w: {case}), ' ')"
    return f"list_distinct(list_concat({_tokens_sql(t)}, {_tokens_sql(extra)}))"


DOCS_SQL = f"""docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
fields AS (
  SELECT doc_id, lines[1] AS title, coalesce(lines[2], '') AS description,
         array_to_string(list_slice(lines, 3, greatest(len(lines), 2)), chr(10)) AS detect, text FROM docs),
qs AS (SELECT item_id AS q, {_qterms_sql('text')} AS terms FROM benchmark),
qt AS (SELECT DISTINCT q, unnest(terms) AS term FROM qs),
idx AS (SELECT doc_id AS d, unnest(list_distinct({_tokens_sql('title')})) AS term, 3 AS w FROM fields
        UNION ALL SELECT doc_id, unnest(list_distinct({_tokens_sql('description')})), 2 FROM fields
        UNION ALL SELECT doc_id, unnest(list_distinct({_tokens_sql('detect')})), 1 FROM fields),
kw_s AS (SELECT q, d, sum(w) AS score FROM qt JOIN idx USING (term) GROUP BY q, d),
kw AS (SELECT * FROM (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM kw_s WHERE score > 0) z WHERE rank <= {{depth}}),
dterms AS (SELECT doc_id AS d, list_distinct({_tokens_sql('text')}) AS dt FROM documents),
ov_i AS (SELECT q, d, count(*) AS i FROM qt JOIN (SELECT d, unnest(dt) AS term FROM dterms) x USING (term) GROUP BY q, d),
ov_j AS (SELECT ov_i.q, ov_i.d, i / (len(qs.terms) + len(dterms.dt) - i) AS jac FROM ov_i JOIN qs USING (q) JOIN dterms USING (d)),
ov AS (SELECT * FROM (SELECT q, d, jac, row_number() OVER (PARTITION BY q ORDER BY jac DESC, d) AS rank FROM ov_j) z WHERE rank <= {DEPTH}),
ov_ok AS (SELECT * FROM ov WHERE q IN (SELECT q FROM ov GROUP BY q HAVING max(jac) >= {FLOOR})),
fz AS (SELECT q, d, sum(rr) AS fused FROM (SELECT q, d, 1.0 / (60 + rank) AS rr FROM kw WHERE rank <= {DEPTH}
        UNION ALL SELECT q, d, 1.0 / (60 + rank) FROM ov_ok) u GROUP BY q, d),
hy AS (SELECT * FROM (SELECT q, d, fused, row_number() OVER (PARTITION BY q ORDER BY fused DESC, d) AS rank FROM fz) z WHERE rank <= {TOPK})
"""


def _docs_sql(depth: int) -> str:
    return "WITH " + DOCS_SQL.replace("{depth}", str(depth))


@query(
    "text_tokens",
    f"SELECT doc_id, len(list_distinct({_tokens_sql('text')})) AS n_tokens, "
    f"md5(array_to_string(list_sort(list_distinct({_tokens_sql('text')})), ' ')) AS tokens_md5 FROM documents",
)
def q_text_tokens(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    per = SR.document_terms(d, "doc_id", "text")
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    # documents without an id still get a row
    return d.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.size(terms).cast("long").alias("n_tokens"), F.md5(F.array_join(terms, " ")).alias("tokens_md5")
    )


@query("keyword_topk", _docs_sql(3) + "SELECT q, d, score, rank FROM kw")
def q_keyword_topk(spark, sf_dir):
    return keyword_ranked(spark, sf_dir, 3).select("q", "d", "score", "rank")


@query(
    "cosine_topk",
    f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    un AS (SELECT vec_id, label, list_transform(v, lambda x: x / CASE WHEN sqrt(list_sum(list_transform(v, lambda y: y * y))) = 0 THEN 1.0
                                                      ELSE sqrt(list_sum(list_transform(v, lambda y: y * y))) END) AS v FROM u),
    ex AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(generate_series(0, len(v) - 1)) AS i FROM un) z GROUP BY label, i),
    c0 AS (SELECT label, list(x ORDER BY i) AS c FROM ex GROUP BY label),
    c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM c0),
    s AS (SELECT c.label AS q, un.vec_id AS d, list_sum(list_transform(list_zip(c.c, un.v), lambda p: p[1] * p[2])) AS sim FROM c, un)
    SELECT q, d, round(sim, 4) AS sim, rank FROM (SELECT q, d, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS rank FROM s) z
    WHERE rank <= {TOPK}""",
)
def q_cosine_topk(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    cents = SR.centroids(e, "label", "embedding")
    out = SR.cosine_topk(e, "vec_id", "embedding", cents, "label", "embedding", TOPK)
    return out.select("q", "d", F.round("sim", 4).alias("sim"), "rank")


@query("rrf_fusion", _docs_sql(DEPTH) + "SELECT q, d, round(fused, 9) AS fused, rank FROM hy")
def q_rrf_fusion(spark, sf_dir):
    ov = cut_lineage(overlap_ranked(spark, sf_dir, DEPTH))
    return fused(keyword_ranked(spark, sf_dir, DEPTH), ov).select("q", "d", F.round("fused", 9).alias("fused"), "rank")


_FOCUS_SQL = """array_to_string(list_filter(list_transform(
      CASE WHEN list_position(list_transform(string_split(text, chr(10)), lambda l: starts_with(l, '## Autonomy')), true) > 0
           THEN list_slice(string_split(text, chr(10)), 1, list_position(list_transform(string_split(text, chr(10)), lambda l: starts_with(l, '## Autonomy')), true) - 1)
           ELSE string_split(text, chr(10)) END,
      lambda l: CASE WHEN starts_with(l, '# ') THEN substr(l, 3) WHEN l = '' OR starts_with(l, '#') OR starts_with(l, 'Problem ID:') THEN NULL ELSE l END),
    lambda l: l IS NOT NULL), ' ')"""


@query("page_focus", f"SELECT doc_id, md5({_FOCUS_SQL}) AS focus_md5, length({_FOCUS_SQL}) AS focus_chars FROM documents")
def q_page_focus(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    f = SR.page_focus(F.col("text"))
    return d.select("doc_id", F.md5(f).alias("focus_md5"), F.length(f).alias("focus_chars"))


@query(
    "passage_lookup",
    "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE trim(b.text) <> ''",
)
def q_passage_lookup(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return SR.passage_hits(b, "item_id", "text", d, "doc_id", "text")


@query(
    "retrieval_eval",
    _docs_sql(DEPTH)
    + """, truth AS (SELECT b.item_id AS q, d.doc_id AS d FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    lists AS (SELECT 'keyword' AS method, q, d, rank FROM kw UNION ALL SELECT 'overlap', q, d, rank FROM ov
              UNION ALL SELECT 'hybrid', q, d, rank FROM hy),
    hits AS (SELECT l.method, l.q, bool_or(l.rank = 1) AS top1, bool_or(l.rank <= 3) AS top3
             FROM lists l JOIN truth t ON t.q = l.q AND t.d = l.d GROUP BY l.method, l.q),
    m AS (SELECT unnest(['keyword', 'overlap', 'hybrid']) AS method)
    SELECT m.method, count(h.q) FILTER (WHERE h.top1) AS top1, count(h.q) FILTER (WHERE h.top3) AS top3,
           (SELECT count(DISTINCT q) FROM truth) AS questions
    FROM m LEFT JOIN hits h USING (method) GROUP BY m.method""",
)
def q_retrieval_eval(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = SR.passage_hits(b, "item_id", "text", d, "doc_id", "text")
    truth = cut_lineage(found.select(F.col("item_id").alias("q"), F.col("doc_id").alias("d")))
    kw, ov = (cut_lineage(ranked(spark, sf_dir, DEPTH)) for ranked in (keyword_ranked, overlap_ranked))
    lists = (
        kw.select(F.lit("keyword").alias("method"), "q", "d", "rank")
        .unionByName(ov.select(F.lit("overlap").alias("method"), "q", "d", "rank"))
        .unionByName(fused(kw, ov).select(F.lit("hybrid").alias("method"), "q", "d", "rank"))
    )
    hits = lists.join(truth, ["q", "d"]).groupBy("method", "q").agg(
        F.bool_or(F.col("rank") == 1).alias("top1"), F.bool_or(F.col("rank") <= 3).alias("top3")
    )
    methods = spark.createDataFrame([("keyword",), ("overlap",), ("hybrid",)], "method string")
    per = methods.join(hits, "method", "left").groupBy("method").agg(
        F.count_if(F.col("top1")).alias("top1"), F.count_if(F.col("top3")).alias("top3")
    )
    asked = truth.agg(F.count_distinct("q").alias("questions")).scalar()
    return per.withColumn("questions", asked.cast("bigint"))


@query(
    "reconcile_results",
    GOV.GOLD_CTES + """, t AS (SELECT unit, sum(avg_heart_rate * reading_count) / nullif(sum(reading_count), 0) AS truth FROM live GROUP BY unit),
    a AS (SELECT unit, avg(avg_heart_rate) AS answer FROM live GROUP BY unit)
    SELECT coalesce(t.unit, a.unit) AS unit, round(truth, 6) AS truth, round(answer, 6) AS answer,
      CASE WHEN answer IS NULL AND truth IS NOT NULL THEN 'no_answer' WHEN truth IS NULL AND answer IS NOT NULL THEN 'unexpected'
           WHEN abs(truth - answer) <= 0.5 THEN 'correct' ELSE 'wrong' END AS status
    FROM t FULL OUTER JOIN a ON t.unit = a.unit""",
)
def q_reconcile_results(spark, sf_dir):
    """The weighted average (truth) against the average of window averages
    (a typical wrong answer), per unit, tolerance 0.5."""
    live = GOV.gold(spark, sf_dir)("gold_live_vitals_by_unit")
    truth = live.groupBy("unit").agg((F.sum(F.col("avg_heart_rate") * F.col("reading_count")) / F.sum("reading_count")).alias("value"))
    answer = live.groupBy("unit").agg(F.avg("avg_heart_rate").alias("value"))
    r = E.reconcile(truth, answer, ["unit"], 0.5)
    return r.select("unit", F.round("truth", 6).alias("truth"), F.round("answer", 6).alias("answer"), "status")
