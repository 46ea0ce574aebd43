import math
import random

import numpy as np
import pytest

from tidepool.llm import language_id as L

WORDS = {"aa": ["thar", "grim", "ostel", "vand"], "bb": ["quilo", "perra", "añil", "zoco"], "cc": ["ßem", "über", "knot", "wisp"]}


def docs_for(rng):
    return [(" ".join(rng.choices(w, k=40)), lang) for lang, w in WORDS.items() for _ in range(10)]


def page(lang, declared, text):
    return f'<html lang="{declared}"><body><nav>thar thar thar</nav><article><p>{text}</p></article></body></html>'


def pages_for(rng):
    rows = []
    for i in range(150):
        lang = rng.choice(list(WORDS))
        declared = lang if rng.random() < 0.8 else rng.choice(list(WORDS))
        host = f"{lang}.site{rng.randrange(3)}.example" if rng.random() < 0.8 else "mixed.example"
        text = " ".join(rng.choices(WORDS[lang], k=rng.choice([0, 1, 30])))
        rows.append((i, f"http://{host}/{declared}/{i}", page(lang, declared, text), lang))
    return rows


def brute(pages, docs):
    """The same fusion, page by page."""
    langs = sorted({l for t, l in docs if l is not None and t is not None})
    counts = {l: np.full(L.BUCKETS, L.SMOOTH_TRIGRAM) for l in langs}
    for t, l in docs:
        if l is not None and t is not None:
            counts[l] += np.bincount(L.trigram_buckets(np.frombuffer(t.encode(), np.uint8)), minlength=L.BUCKETS)
    logp = {l: np.log(c / c.sum()) for l, c in counts.items()}

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    seen = []
    for i, url, html in pages:
        p = L.Page(html or "")
        text = "\n".join(t for at, t in p.blocks if not p.noise[at])
        x = L.trigram_buckets(np.frombuffer(text.encode(), np.uint8))
        log = [L.TRIGRAM_SHARE * logp[l][x].sum() for l in langs]
        d = L.DECLARED.search(html or "")
        host = L.host_of(url)
        seen.append((i, log, softmax(log), {"host": host, "domain": L.domain_of(host), "declared": d[1].lower() if d else "", "address": L.address_of(url)}))
    n, out = len(langs), []

    def total(key, value):
        return [sum(s[2][k] for s in seen if key is None or s[3][key] == value) for k in range(n)]

    every = total(None, None)
    kinds = {key: len({s[3][key] for s in seen}) for key in ("declared", "address")}
    for i, log, own, at in seen:
        minus = {k: [max(a - b, 0) for a, b in zip(total(k, at[k]), own)] for k in ("host", "domain")}
        fused = []
        for k in range(n):
            v = log[k]
            for key in ("declared", "address"):
                v += math.log((total(key, at[key])[k] + 1) / (every[k] + kinds[key]))
            domain = (minus["domain"][k] + 20 * (every[k] + 1) / (sum(every) + n)) / (sum(minus["domain"]) + 20)
            fused.append(v + math.log((minus["host"][k] + 10 * domain) / (sum(minus["host"]) + 10)))
        p = softmax(fused)
        out.append((i, langs[p.index(max(p))], round(max(p), 9), langs[own.index(max(own))]))
    return out


def run(spark, pages, docs):
    p = spark.createDataFrame([(*r[:3], "x") for r in pages], "page_id long, url string, html string, host string")
    d = spark.createDataFrame([(t, l, 1) for t, l in docs], "text string, lang string, url int")
    return [(r["page_id"], r["lang"], round(r["probability"], 9), r["text_lang"]) for r in L.identify(p, d).collect()]


def test_same_as_fusing_page_by_page_and_right(spark):
    rng = random.Random(6)
    pages, docs = pages_for(rng), docs_for(rng) + [(None, "aa"), ("x", None), ("", "bb")]
    odd = [(900, None, pages[0][2]), (901, "nohost", None), (902, "http://mixed.example", ""), (None, "http://mixed.example/aa/1", "<p>thar</p>"), pages[3][:3]]
    rows = [r[:3] for r in pages] + odd + [(903, pages[5][1], page("aa", "aa", "thar grim " * 20_000))]
    got = run(spark, rows, docs)
    assert sorted(got, key=str) == sorted(brute(rows, docs), key=str)
    truth = {r[0]: r[3] for r in pages}
    assert np.mean([g[1] == truth[g[0]] for g in got if g[0] in truth]) > 0.9


def test_evidence_decides_where_text_is_missing(spark):
    rng = random.Random(7)
    rows = [(i, f"http://a.example/aa/{i}", page("aa", "aa", " ".join(rng.choices(WORDS["aa"], k=20)))) for i in range(30)]
    rows += [(100 + i, f"http://b.example/bb/{i}", page("bb", "bb", " ".join(rng.choices(WORDS["bb"], k=20)))) for i in range(30)]
    got = {g[0]: g[1] for g in run(spark, [*rows, (500, "http://b.example/bb/x", None)], docs_for(rng))}
    assert got[500] == "bb"


@pytest.mark.parametrize("url,want", [("http://h.de/fr/x", "/fr"), ("http://h.de/en-US/x", "/en"), ("http://h.de/fra/x", ".de"), ("http://h.de/EN", "/en"), (None, "."), ("x", ".")])
def test_addresses(url, want):
    assert L.address_of(url) == want


def test_empty_tables(spark):
    docs = docs_for(random.Random(1))
    assert run(spark, [], docs) == []
    d = spark.createDataFrame([], "text string, lang string")
    p = spark.createDataFrame([(1, "http://h.de/fr/", "<p>x</p>")], "page_id long, url string, html string")
    assert [tuple(r)[:5] for r in L.identify(p, d).collect()] == [(1, "http://h.de/fr/", None, None, None)]
