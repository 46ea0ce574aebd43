"""The corpus pipeline: toxicity, near-duplicates, substrings, contamination, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``:

* toxicity drops the documents that the classifier predicts to be toxic;
* near_duplicates keeps of each component the row of the smallest doc_id (a
  null doc_id only where a component has no other; of equal ids, and of rows
  without an id, the smallest text);
* substring_dedup removes from each text the words covered by a 50-word window
  that also starts in a document with a smaller doc_id, and sets n_chars;
* decontamination drops contaminated documents;
* packing returns the pieces of the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontamination as bench
from tidepool.llm import packing as pack
from tidepool.llm import simhash, substring_dedup, toxicity
from tidepool.llm.common import read_columns
from tidepool.llm.queries import tokenizer_path
from tidepool.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_columns(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return toxicity.without_toxic(docs.select(*COLUMNS), labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS))


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bench.without_contaminated(docs.select(*COLUMNS), read_columns(spark, sf_dir, "benchmark", ["item_id", "text"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_substrings),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Toxicity and packing have no SQL form; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written
    to the shared checkpoint folder and read again."""
    docs = read_columns(spark, sf_dir, "documents", COLUMNS)
    for _, stage in STAGES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
