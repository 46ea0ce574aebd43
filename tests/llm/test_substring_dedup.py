import hashlib
import random

import pytest

from tidepool.llm import passages
from tidepool.llm import substring_dedup as S


def brute(docs, window):
    words = [(t or "").encode().split() for _, t in docs]
    least = {}
    for (d, _), w in zip(docs, words):
        if d is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                least[k] = min(d, least.get(k, d))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        if d is not None:
            for p in range(len(w) - window + 1):
                if least[tuple(w[p : p + window])] < d:
                    gone |= set(range(p, p + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "\x85", "x y"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = say(window * 3 // 5)  # stands in many surroundings, too short to go
    whole = [say(rng.choice([0, 1, window - 1, window, 3 * window, 8 * window])) for _ in range(15)]
    docs = []
    for i in range(60):
        w = list(rng.choice(whole))
        for _ in range(rng.choice([0, 0, 1, 3])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            a = rng.choice(whole)
            p = rng.randrange(len(a) + 1)
            w = say(9) + a[p : p + window + rng.choice([-1, 0, 1, 7])] + say(9) + w
        if rng.random() < 0.4:
            w = w + line + say(rng.choice([0, 3]))
        if rng.random() < 0.2:
            w = w + ["|"] * (2 * window) + ["a", "b"] * window
        docs.append((rng.randrange(1000), rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(docs[3][0], docs[3][1]), (docs[4][0], docs[5][1]), (None, docs[9][1]), (None, docs[9][1]), (2000, None), (2001, "")]
    docs.append((5000, " ".join(docs[9][1].split() * 40)))
    return docs


@pytest.mark.parametrize("window,gram,full,shard", [(50, 16, 512, 60_000), (10, 4, 512, 300), (10, 4, 1, 300), (12, 3, 3, 50)])
def test_same_as_brute_force(spark, monkeypatch, window, gram, full, shard):
    monkeypatch.setattr(passages, "FULL", full)
    monkeypatch.setattr(S, "SHARD_WORDS", shard)
    docs = corpus(window + full, window)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, choice string")
    got = sorted((tuple(r) for r in S.substring_dedup(df, window, gram).collect()), key=str)
    assert got == brute(docs, window)


def test_columns_stay_and_text_is_cut(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, body, "en", "a", 9), (2, "x  y " + body + "\nz", "de", None, 3), (3, "un touched", None, "c", 1), (None, body, "", "", 0), (4, None, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = S.without_repeats(df)
    assert got.columns == df.columns
    want = [rows[0], (2, "x y z", "de", None, 3), *rows[2:]]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_automaton_finds_the_smallest_owner_of_each_window():
    rng = random.Random(1)
    texts = [([rng.randrange(4) for _ in range(rng.randrange(40))], rng.randrange(20)) for _ in range(30)]
    a = S.SuffixAutomaton()
    for t, o in texts:
        a.add(t, o)
    a.finish()
    for n in (1, 3, 6):
        least = {}
        for t, o in texts:
            for p in range(len(t) - n + 1):
                k = tuple(t[p : p + n])
                least[k] = min(o, least.get(k, o))
        probe = [rng.randrange(4) for _ in range(300)] + [9] + texts[0][0]
        assert a.owners_of(probe, n) == [least.get(tuple(probe[p : p + n])) for p in range(len(probe) - n + 1)]


def test_empty_table(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
