import hashlib
import random
import re

from tidepool.llm.decontamination import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    keys = {}
    for item_id, text in items:
        w = words(text)
        n = min(len(w), 13)
        for p in range(len(w) - n + 1 if w else 0):
            keys.setdefault(tuple(w[p : p + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in keys}:
            for p in range(len(w) - n + 1):
                if (ids := keys.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= ids
        names = ",".join(sorted(str(x) for x in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in contamination(d, b).collect()), key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    vocab = ["Über", "a", "B", "c9", "été", "d", "E", "fg"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([3, 7, 12, 13, 14, 40]))) for i in range(12)] + [(50, ""), (51, None), (52, "- !"), (3, "once more")]
    items += [(60, items[5][1]), (60, items[5][1])]
    docs = [(i, say(rng.choice([0, 1, 5, 13, 60, 300]))) for i in range(60)]
    for i in range(60, 90):  # exact spans of 13 words and of 12, at any place
        w = rng.choice(items)[1] or "x"
        w = w.split()
        n = rng.choice([12, 13, 14])
        p = rng.randrange(max(1, len(w) - n + 1))
        docs.append((i, say(20) + " " + " ".join(w[p : p + n]) + " " + say(20)))
    docs += [(70, docs[70][1]), (70, "another text"), (None, docs[65][1]), (500, None), (501, "one " * 20_000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_boundary_of_the_rule(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    docs = [(n, passage + " " + " ".join(f"x{i}" for i in range(n))) for n in (246, 247, 248)]
    got = {r[0]: (r[2], r[5]) for r in run(spark, docs, [(1, passage)])}
    assert got == {246: (13, True), 247: (13, True), 248: (13, False)}


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
