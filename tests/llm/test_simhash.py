import random

import numpy as np
import xxhash

from tidepool.llm import simhash as S
from tidepool.llm.graph import components


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\n" if c in " \t\n\v\f\r" else c for c in lowered).split("\n") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    prints = [slow_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"W{i}é" for i in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([2, 3, 30, 120]))) for _ in range(25)]
    docs = list(enumerate(base))
    for i in range(25, 120):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((i, "\t ".join(w).upper()))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "two words"), (203, "one"), (None, base[0]), (None, "alone " * 9)]
    docs += [(210, "Nel\x85mezzo del x"), (300, "long text here " * 30_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fingerprint string")
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=str)
    assert got == brute(docs)


def all_links(prints, distance):
    return {(int(a), int(b)) for a in prints for b in prints if a > b and int(a ^ b).bit_count() <= distance}


def closure(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_cells_lose_no_link_even_when_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    prints = set()
    for _ in range(12):
        c = int(rng.integers(0, 1 << 63))
        for _ in range(30):
            x = c
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    for distance, limit in ((3, 4096), (3, 5), (1, 7), (5, 4096)):
        monkeypatch.setattr(S, "CELL_ROWS", limit)
        got = {tuple(int(np.int64(v).view(np.uint64)) for v in r) for r in S.links(df, distance).collect()}
        want = all_links(prints, distance)
        assert all(bin(a ^ b).count("1") for a, b in got)
        assert closure(got) == closure(want)


def test_bound_is_never_above_the_bit_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, (2, 2000)).astype(np.uint64)
    bound = np.abs(S.segment_counts(a) - S.segment_counts(b)).sum(axis=1)
    assert (bound <= np.bitwise_count(a ^ b)).all() and (S.segment_counts(a).sum(axis=1) == np.bitwise_count(a)).all()


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2001, 2000), (2001, 2000)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(40)}, 2000: 2000, 2001: 2000}
    assert components(df.limit(0)).count() == 0


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
