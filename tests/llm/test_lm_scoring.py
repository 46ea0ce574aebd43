import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidepool.llm import lm_scoring as L


def tiny(seed=0, words=70, hidden=5):
    rng = np.random.default_rng(seed)
    net = L.new_network(rng.integers(1, 99, words).astype(float), rng.integers(0, 50, L.SHAPES), rng.integers(0, 9, L.SHAPES), hidden)
    return {k: (v + rng.normal(size=v.shape) * 0.3 * (v > -1e3)).astype(np.float64) for k, v in net.items()}


def test_gradients_against_differences():
    net, rng = tiny(), np.random.default_rng(1)
    ids = np.r_[rng.integers(0, 70, 9), rng.integers(96, 96 + L.SHAPES, 9)][rng.permutation(18)].reshape(3, 6)
    start = rng.random((3, 6)) < 0.3
    h = rng.normal(size=(3, 5))
    loss, grad, _ = L.window_gradients(net, h, ids, start)
    for name in net:
        places = [np.unravel_index(i, net[name].shape) for i in np.argsort(-np.abs(grad[name]).ravel())[:6]]
        for at in places:
            moved = []
            for d in (1e-4, -1e-4):
                other = {k: v.copy() for k, v in net.items()}
                other[name][at] += d
                moved.append(L.window_gradients(other, h, ids, start)[0])
            assert grad[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-4, rel=2e-2, abs=2e-5)


def test_probabilities_of_all_classes_and_members_sum_to_one():
    net = tiny()
    h = np.random.default_rng(3).normal(size=(1, 5))
    ids = np.r_[np.arange(70), 96 + np.arange(L.SHAPES)]  # 70 words in three classes of 32, then the shapes
    p = np.exp(L.log_probabilities(net, np.repeat(h, len(ids), 0), ids))
    assert p.sum() == pytest.approx(1, abs=1e-6)


def test_documents_in_step_score_as_one_by_one(monkeypatch):
    monkeypatch.setattr(L, "SCORE_DOCS", 4)
    net, rng = tiny(), np.random.default_rng(5)
    docs = [rng.integers(0, 70, n) for n in (1, 200, 33, 32, 64, 7, 1, 90, 31)]
    want = []
    for d in docs:
        h, total = np.zeros((1, 5)), 0.0
        for t in d:
            total += L.log_probabilities(net, h, np.array([t]))[0]
            h = L.step(net, h, np.array([t]))[0]
        want.append(total)
    assert L.document_scores(net, docs) == pytest.approx(want, abs=1e-3)


def test_learning_lowers_the_loss():
    docs = [np.array([1, 2, 3, 4] * 40) for _ in range(40)]
    net = L.new_network(np.full(64, 5.0), np.ones(L.SHAPES), np.ones(L.SHAPES))
    before = L.document_scores(net, docs[:1])[0]
    for turn in range(3):
        net = L.learn(net, docs, 0.01, turn)
    assert L.document_scores(net, docs[:1])[0] > 0.5 * before


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def corpus():
    rng = random.Random(2)
    vocab = {k: [f"{k}{i}" for i in range(120)] for k in "pq"}
    docs = [(i, " ".join(rng.choices(vocab[rng.choice("pq")], k=rng.choice([0, 3, 80])))) for i in range(150)]
    docs = [(i, " ".join(rng.choices(vocab["pq"[i % 2]], k=len(t.split())))) for i, t in docs]
    return docs + [(None, "P1 no id"), (500, None), (501, " \t"), (3, docs[3][1]), (502, "new éÉ, words "), (503, "p1 Q2. " * 9_000)]


@pytest.mark.parametrize("broadcast,flush", [(200_000, 400_000), (10, 50)])
def test_base_score_and_counts(spark, monkeypatch, broadcast, flush):
    for name, value in (("BROADCAST_WORDS", broadcast), ("COUNT_FLUSH", flush), ("TOP", min(40, broadcast)), ("ROUNDS", 2), ("SHARE_DOCS", 1), ("LEAST_DOCS", 40)):
        monkeypatch.setattr(L, name, value)
    docs = corpus()
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5
    count = Counter(w for d, t in docs if fold(d) != 1 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for d, t in docs:
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.append((d, fold(d) == 1, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(base, 5)))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int")
    got = L.score(df).collect()
    assert sorted((tuple(r)[:5] + (round(r["base_score"], 5),) for r in got), key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("least,parts", [(10, 5), (50, 2), (2_000, 1)])
def test_the_network_learns_from_every_training_document(spark, monkeypatch, least, parts):
    monkeypatch.setattr(L, "LEAST_DOCS", least)
    monkeypatch.setattr(L, "SHARE_DOCS", 20)
    seen = []
    monkeypatch.setattr(L, "train", lambda dealt, net: seen.extend(dealt.collect()) or net)
    docs = corpus()
    L.score(spark.createDataFrame(docs, "doc_id long, text string"))
    training = [t for d, t in docs if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1]
    assert sorted(len(r["ids"]) // 2 for r in seen) == sorted(len(tokens(t)) for t in training)
    assert {r["part"] for r in seen} == set(range(parts))  # a part for each round: all are read


def test_held_out_documents_score_above_the_base(spark):
    docs = [(d, t) for d, t in corpus() if d is not None and t and len(t.split()) > 20]
    got = [r for r in L.score(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["held_out"]]
    assert got and np.mean([r["score"] > r["base_score"] for r in got]) > 0.9


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in L.score(df).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    assert L.score(df.limit(0)).count() == 0


def test_every_token_reaches_backpropagation(monkeypatch):
    """Also those that are left over when the text is cut into equal streams."""
    seen = []
    real = L.window_gradients

    def watched(net, h, ids, start):
        seen.append(np.array(ids).ravel())
        assert h.shape[0] == ids.shape[0] == start.shape[0]
        return real(net, h, ids, start)

    monkeypatch.setattr(L, "window_gradients", watched)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 70, n) for n in (700, 13, 1, 3000, 301)]
    L.learn(tiny(), docs, 0.01, 3)
    assert sorted(np.concatenate(seen).tolist()) == sorted(np.concatenate(docs).tolist())
    assert sum(map(len, seen)) % max(1, min(L.STREAMS, sum(map(len, docs)) // (8 * L.STEPS))) != 0


def test_words_that_go_along_are_bounded_at_the_driver(spark, monkeypatch):
    counts = spark.createDataFrame([("a", 9), ("c", 4), ("b", 4), ("d", 3), *[(f"x{i:02d}", 1) for i in range(40)]], "word string, n long").repartition(8)
    monkeypatch.setattr(L, "TOP", 2)
    monkeypatch.setattr(L, "BROADCAST_WORDS", 10)
    assert L.frequent_words(counts) == (["a", "b"], [("a", 9), ("b", 4), ("c", 4), ("d", 3)])  # a count goes along whole or not at all
    monkeypatch.setattr(L, "BROADCAST_WORDS", 44)
    assert [w for w, _ in L.frequent_words(counts)[1]] == ["a", "b", "c", "d", *[f"x{i:02d}" for i in range(40)]]
    monkeypatch.setattr(L, "TOP", 6)
    monkeypatch.setattr(L, "BROADCAST_WORDS", 3)
    assert [w for w, _ in L.frequent_words(counts)[1]] == ["a", "b", "c", "d", "x00", "x01"]
    assert L.frequent_words(counts.limit(0)) == ([], [])


def test_rows_are_added_as_numpy_adds_them():
    rng = np.random.default_rng(3)
    for at in (rng.zipf(1.5, 500) % 40, np.array([7, 7, 7]), np.array([2]), np.array([], np.int64)):
        rows = rng.normal(size=(len(at), 6)).astype(np.float32)
        want, got = np.zeros((40, 6), np.float32), np.zeros((40, 6), np.float32)
        np.add.at(want, at, rows)
        L.add_rows(got, at, rows)
        assert np.array_equal(got, want)


def test_logits_beyond_the_reach_of_an_exponential():
    """Weights may grow until exp of a logit overflows or a whole row vanishes."""
    ids = np.r_[np.arange(70), 96 + np.arange(L.SHAPES)]
    h = np.repeat(np.random.default_rng(3).uniform(-1, 1, (1, 5)), len(ids), 0).astype(np.float32)
    for far in (300.0, -300.0):
        net = {k: v.astype(np.float32) for k, v in tiny().items()}
        net["class_bias"] += np.float32(far)
        net["member_bias"][net["member_bias"] > -1e3] += np.float32(far)
        assert not any(near for _, near in L.heads(net))
        p = np.exp(L.log_probabilities(net, h, ids).astype(float))
        assert p.sum() == pytest.approx(1, abs=1e-4)
        loss, grad, _ = L.window_gradients(net, h[:2], ids[60:100].reshape(2, 20), np.zeros((2, 20), bool))
        assert np.isfinite(loss) and all(np.isfinite(g).all() for g in grad.values())


def test_learning_is_adam_over_all_weights():
    """One array of all weights takes the step that each one took by itself."""
    rng, net = np.random.default_rng(4), tiny()
    docs = [rng.integers(0, 70, n) for n in (300, 13, 1, 250)]
    want, turn = {k: v.copy() for k, v in net.items()}, 0
    order = np.random.default_rng(3).permutation(len(docs))
    ids = np.concatenate([docs[i] for i in order])
    start = np.zeros(len(ids), bool)
    start[np.cumsum([0] + [len(docs[i]) for i in order])[:-1]] = True
    streams = len(ids) // (8 * L.STEPS)
    length = len(ids) // streams
    h = np.zeros((streams, 5))
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    for a, b in ((0, streams * length), (streams * length, len(ids))):
        rows, begins = ids[a:b].reshape(streams if not a else 1, -1), start[a:b].reshape(streams if not a else 1, -1).copy()
        if not a:
            begins[:, 0] = True
        h = h[-len(rows) :]
        for t in range(0, rows.shape[1], L.STEPS):
            turn += 1
            _, grad, h = L.window_gradients(want, h, rows[:, t : t + L.STEPS], begins[:, t : t + L.STEPS])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                want[k] = want[k] - 0.01 * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-6)
    got = L.learn(net, docs, 0.01, 3)
    for k in want:
        assert got[k].shape == want[k].shape and np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9)


def test_words_are_those_that_python_splits():
    rng = random.Random(1)
    signs = ["a", "B", "é", "É", " ", " ", "\x1c", "\x85", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", "𝔘"]
    texts = [None, "", " \t", " a", "B ", *("".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(500))]
    words, sizes = L.words_of(pa.array(texts).slice(1))
    want = [t.encode().lower().split() for t in texts[1:]]
    assert [w.encode() for w in words.to_pylist()] == [w for t in want for w in t]
    assert sizes.tolist() == [len(t) for t in want]
    assert [len(x) for x in L.words_of(pa.array([], pa.string()))] == [0, 0]


def test_shape_classes_of_many_words_at_once():
    rng = random.Random(2)
    words = [L.END, *("".join(rng.choices("abz09,.!?-É𝔘\x00~`@[{", k=rng.randrange(7))) for _ in range(2_000))]
    assert L.shape_classes(pa.array(words).slice(1)).tolist() == [L.shape_class(w.encode()) for w in words[1:]]
    assert L.shape_classes(pa.array(["", ""])).tolist() == [L.shape_class(b"")] * 2
    assert L.shape_classes(pa.array([L.END])).tolist() == [L.shape_class(L.END.encode())]


def test_texts_are_read_for_the_counts_and_once_more(spark, monkeypatch):
    """Learning and scoring both go by the ids that the second reading wrote."""
    real, reading = L.stage_table, []

    def watched(df):
        if "text#" in df._jdf.queryExecution().optimizedPlan().toString():
            reading.append(df.columns)
        return real(df)

    monkeypatch.setattr(L, "stage_table", watched)
    got = L.score(spark.createDataFrame(corpus(), "doc_id long, text string"))
    assert len(reading) == 2 and "text#" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == len(corpus())


def test_groups_of_many_rows_are_added_as_single_rows_are():
    rng = np.random.default_rng(5)
    for most, ids in ((96, rng.zipf(1.3, 900) % 96), (96, rng.integers(0, 96, 40)), (64, np.full(200, 63)), (32, np.array([], int))):
        rows = rng.normal(size=(3, len(ids), 6))
        want, got = np.zeros((3, most, 6)), np.zeros((3, most, 6))
        for part in range(3):
            np.add.at(want[part], ids, rows[part])
        L.add_groups(got, ids, rows, *L.by_id(ids, most))
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("rows", [0, 1, 127, 128, 129, 300])
def test_products_by_pieces(rows):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(rows, 5)), rng.normal(size=(5, 7))
    assert np.allclose(L.product(a, b, np.empty((rows, 7))), a @ b)
