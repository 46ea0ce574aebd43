"""The stages one after another, each against a plain version on its own input."""

import importlib

import pytest

from tests.llm import test_decontamination as decontamination
from tests.llm import test_simhash as near
from tests.llm import test_substring_dedup as substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and after each stage."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.limit(3).unionByName(docs.where("doc_id = 9").withColumn("doc_id", docs.doc_id * 0 - 1))
    odd = spark.createDataFrame([(None, "no id", None, None, None), (9_000, None, "en", "s", 0), (9_001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(copies).unionByName(odd)
    tables = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, tables[-1], SF).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns_stay_until_the_last(stages):
    assert all(t.columns == stages[0].columns and t.dtypes == stages[0].dtypes for t in stages[:-1])


def test_toxicity_drops_what_it_predicts(spark, stages):
    from tidepool.llm import toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {(r["doc_id"], r["predicted"]) for r in toxicity.score(stages[0], labels).collect()}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if (r[0], 0) in judged]


def test_one_document_of_each_component_stays(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    parts = near.brute(docs)
    want = {c for _, _, c in parts}
    got = [r["doc_id"] for r in stages[2].collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and set(rows(stages[2])) <= set(rows(stages[1]))


def test_words_that_an_earlier_document_holds_go(stages):
    docs = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {(d, digest) for d, _, _, digest in substrings.brute(docs, 50)}
    import hashlib

    got = {(r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in stages[3].collect()}
    assert got == want and stages[3].count() == len(docs)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect() if r["text"] is not None)


def test_contaminated_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    gone = {r[0] for r in decontamination.brute(docs, items) if r[5]}
    assert rows(stages[4]) == [r for r in rows(stages[3]) if r[0] not in gone]


def test_the_rest_is_packed_whole(stages):
    from tidepool.llm.packing import WordIds
    from tidepool.llm.queries import tokenizer_path

    texts = [(r["text"] or "").encode() for r in stages[4].collect()]
    total = sum(len(x) // 4 for x in WordIds(tokenizer_path()).encode(texts))
    assert stages[5].agg({"length": "sum"}).first()[0] == total


def test_run_gives_the_last_stage(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    got = pipeline.run(spark, SF)
    assert got.count() > 0 and got.columns[:3] == ["doc_id", "start", "length"]
