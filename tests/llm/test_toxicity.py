import random
import zlib

import numpy as np

from tidepool.llm import toxicity as T

BAD = ["numpty", "wastrel", "blockhead", "numskull", "scoundrel"]


def made(n, seed=1):
    rng = random.Random(seed)
    parts = ["ta", "ri", "mo", "ent", "ish", "lo", "ka", "ber", "the", "an"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 120))]
        y = int(rng.random() < 0.3)
        for _ in range(rng.randrange(3, 9) * y):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), y))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = made(700)
    docs = spark.createDataFrame([(i, t, "score") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in T.score(docs, labels).collect()}
    assert len(got) == len(rows)
    out = [(got[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([p == y for p, y in out]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= T.THRESHOLD) for r in got.values())


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = made(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")

    def scores(flip):
        labels = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows]
        return {r[0]: r[2] for r in T.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}

    assert scores(False) == scores(True)


def test_odd_rows(spark):
    rows = [(i, t) for i, t, _ in made(80)]
    rows += [(None, "no id"), (200, None), (201, ""), (202, " \n"), (3, rows[3][1]), (203, "numpty wastrel " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, y) for i, _, y in made(80)] + [(None, 1), (5, None), (200, 1), (5, 7)]
    got = T.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (200, 201, 202)}
    assert len(empty) == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, 1)]):
        got = T.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert [(r["score"], r["predicted"]) for r in got] == [(0.0, 0)] * 2
    assert T.score(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_whole_text_is_read():
    text = b"ordinary words " * 5_000 + b"numpty wastrel"
    assert b"".join(T.windows(text)).split() == text.split()


def test_the_fit_is_bounded_in_rows_not_only_in_ids(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = [(i, f"text {i} {k}") for i in ids for k in range(30)] + [(ids[0], "the same")] * 500
    labels = [(i, i % 2) for i in ids]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert T.training_rows(df, known, 10).count() == 10
    every = T.training_rows(df, known, 10_000).collect()
    assert sorted((r["doc_id"], r["text"]) for r in every) == sorted(set(docs))


def test_the_ordinary_dictionary_comes_from_all_ordinary_texts():
    rng = random.Random(4)
    say = lambda letter: " ".join(f"{letter}{rng.randrange(10**6):x}" for _ in range(16)).encode()
    ordinary = [say("a") for _ in range(3_000)] + [say("z") for _ in range(3_000)]
    assert T.train_dictionaries([say("t") for _ in range(20)], ordinary)[0].count(b" z") > 100
