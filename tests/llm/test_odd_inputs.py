"""Very long texts, a line that very many documents share, ties, empty tables
and columns with names of the operators' own."""

import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.test_substring_dedup import brute as plain_substring_dedup
from tidepool.llm import decontamination, packing, simhash, substring_dedup
from tidepool.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def hot_line_docs():
    """A line of 60 words in 150 documents, one of them of 10,000 words."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line = say(60)
    docs = [(i, " ".join(say(rng.randrange(4)) + line + say(rng.randrange(80)))) for i in range(150)]
    long_one = say(10_000)
    for at in (0, 3_000, 9_900):
        long_one[at:at] = line
    docs += [(75, docs[75][1]), (160, " ".join(long_one)), (161, " ".join(long_one[100:400])), (None, " ".join(line))]
    return docs


def test_substring_dedup_of_a_hot_line_and_a_very_long_text(spark):
    docs = hot_line_docs()
    df = spark.createDataFrame([(i, t, "g", 1) for i, t in docs], "doc_id long, text string, gone string, row_key long")
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(df).collect()), key=str)
    assert got == plain_substring_dedup(docs, 50)


def test_decontamination_of_a_very_long_text_ties_and_repeats(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    items = [(i, say(rng.choice([5, 13, 40]))) for i in range(30)]
    items += [(30, items[3][1]), (3, items[3][1]), (31, None), (32, "")]  # ties and repeats
    passage = items[7][1]
    docs = [(i, f"{say(30)} {items[i % 30][1]} {say(30)}") for i in range(40)]
    docs += [(40, f"{say(8_000)} {passage} {say(8_000)}"), (5, docs[5][1]), (41, None), (42, ""), (43, passage)]
    documents = pd.DataFrame(docs, columns=["doc_id", "text"])  # noqa: F841
    benchmark = pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(decontamination.contamination_sql()).fetchall(), key=str)
    left = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, print string")
    right = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, item_window string")
    assert sorted((tuple(r) for r in decontamination.contamination(left, right).collect()), key=str) == want


def test_simhash_of_ties_repeats_and_a_very_long_text(spark):
    rng = random.Random(10)
    long_one = " ".join(f"w{rng.randrange(900)}" for _ in range(15_000))
    rows = [(9, long_one), (4, long_one), (4, long_one), (2, ""), (1, None), (7, "one two"), (8, "One TWO"), (6, "something else altogether")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(9, 4), (4, 4), (2, 1), (1, 1), (7, 7), (8, 7), (6, 6)}


def test_packing_of_repeats_and_a_very_long_text(spark):
    long_one = "many words " * 30_000
    df = spark.createDataFrame([(1, long_one, 5), (2, "same", 5), (2, "same", 5)], "doc_id long, text string, start int")
    rows = packing.pack(df, tokenizer_path()).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sum(n for _, n in by[1, 60_001]) == 60_001 and len(by[2, 2]) == 2 * len({s for s, _ in by[2, 2]})


@pytest.mark.parametrize("rows", [[], [(1, "word " * 10_000, "en", "web", 50_000), (2, None, None, None, None), (3, "", "en", "web", 0)]])
def test_pipeline_stages_on_an_empty_table_and_on_a_very_long_text(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert bool(pieces) == bool(rows)
