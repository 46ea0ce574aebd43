import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidepool.llm import passages, winnow
from tidepool.llm import suffix_dedup as S


def brute(docs, window):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[p : p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for (d, _), t in zip(docs, texts):
        keep = np.ones(len(t), bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                keep[p : p + window] = False
        kept = np.frombuffer(t, np.uint8)[keep].tobytes()
        runs = sum(1 for p in range(len(t)) if not keep[p] and (p == 0 or keep[p - 1]))
        out.append((d, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefgh ijé\n") for _ in range(n))
    line = say(window * 3 // 5)
    whole = [say(rng.choice([0, 1, window - 1, window, 3 * window, 6 * window])) for _ in range(15)]
    docs = []
    for i in range(50):
        t = rng.choice(whole) if rng.random() < 0.8 else say(4 * window)
        for _ in range(rng.choice([0, 0, 1, 3])):
            if t:
                p = rng.randrange(len(t))
                t = t[:p] + rng.choice(["X", "", "yy"]) + t[p + 1 :]
        if rng.random() < 0.3:
            a = rng.choice(whole)
            p = rng.randrange(len(a) + 1)
            t = say(9) + a[p : p + window + rng.choice([-1, 0, 1, 7])] + say(9) + t
        if rng.random() < 0.4:
            t += line + say(rng.choice([0, 3]))
        if rng.random() < 0.1:
            t += "|" * (window + 3) + "ab" * window
        docs.append((i, t))
    once = say(window)
    docs += [(3, docs[3][1]), (4, docs[5][1]), (None, docs[9][1]), (70, None), (71, ""), (72, once + "-" + once), (73, "z" * (window + 1))]
    docs.append((74, docs[9][1] * 30))
    return docs


@pytest.mark.parametrize("window,gram,full,shard", [(200, 32, 512, 6000), (40, 8, 512, 30), (40, 8, 1, 30), (30, 5, 3, 7)])
def test_same_as_brute_force(spark, monkeypatch, window, gram, full, shard):
    monkeypatch.setattr(passages, "FULL", full)
    monkeypatch.setattr(S, "SHARD_CONTENTS", shard)
    docs = corpus(window + full, window)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, place string")
    got = sorted((tuple(r) for r in S.suffix_dedup(df, window, gram).collect()), key=str)
    assert got == brute(docs, window)


def test_sort_and_extensions_against_plain_sorting():
    rng = random.Random(4)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    bodies += bodies[:20]
    group = np.sort(np.array([rng.randrange(12) for _ in bodies]))
    sizes = np.array([len(b) for b in bodies])
    base = np.cumsum(sizes) - sizes
    text = S.HashedText(np.frombuffer(b"".join(bodies), np.uint8))
    order = S.merge_sort(text, base, base + sizes, group)
    assert sorted(order.tolist()) == list(range(len(bodies))) and (group[order] == group).all()
    for g in set(group.tolist()):
        own = [bodies[k] for k in order[group == g]]
        assert own == sorted(own)


def test_hash_collisions_are_seen_by_the_byte_check(monkeypatch):
    # All values hash alike: every extension looks endless, only the bytes tell.
    monkeypatch.setattr(winnow, "BYTE_VALUES", np.ones(256, np.uint64))
    a, b, c = b"x" * 10 + b"SAME" * 10 + b"q" * 10, b"y" * 10 + b"SAME" * 10 + b"r" * 10, b"x" * 10 + b"DIFF" * 10 + b"s" * 10
    lead = np.array([10, 10, 10])
    got = S.shared_windows([a, b, c], lead, np.zeros(3, np.int64), np.ones(3, bool), 30)
    assert got == [[{"from": 10, "until": 21}], [{"from": 10, "until": 21}], []]


def test_empty_table(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
