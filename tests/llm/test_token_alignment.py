"""Alignment against a plain version: links by comparing ranges, counts in a dict."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepool.llm import token_alignment as ta
from tidepool.llm.queries import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))


def plain(tools, texts):
    """The contract, step by step, for each text."""
    a, b = tools
    of = ta.byte_level()
    links, shapes = [], []
    for text in texts:
        whole = f" {text or ''}".encode()
        left = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(whole.decode(), add_special_tokens=False).ids]
        right = [(i, ta.piece_bytes(b.id_to_piece(i))) for i in b.encode(text or "")]
        if not text or any(b"".join(t for _, t in side) != whole for side in (left, right)):
            links.append([])
            shapes.append((0, 0, 0, ""))
            continue
        spans = []
        for side in (left, right):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, _, e in side if start < e <= end) for side in spans))
            start = end
        links.append([(x, y) for x, s, e in spans[0] for y, t, f in spans[1] if max(s, t) < min(e, f)])
        shapes.append((len(left), len(right), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (n_a, n_b, n_groups, len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), digest)
        for own, (n_a, n_b, n_groups, digest) in zip(links, shapes)
    ]


TEXTS = [
    None, "", " ", "  two  spaces ", "The quick brown fox", "The quick brown fox", "naïve café ﬁ ² 日本語 😀\n\nrows\tand\r\nlines",
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "\x00\x01", "x", "antidisestablishmentarianism " * 40, "é", "नमस्ते दुनिया",
    "word " * 3000, "thinking, the re-thinking of thoughts; 1234567890 + 3.14159",
]


@pytest.mark.parametrize("block, common, run", [(1, 2, 10), (200, 2, 100), (ta.BLOCK_BYTES, ta.COMMON, ta.RUN_RECORDS)])
def test_equals_plain_version(spark, tools, block, common, run):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3)
    out = ta.align(df, tokenizer_path(A), tokenizer_path(B), block, common, run).collect()
    want = plain(tools, [t for _, t, _ in rows])
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out} == dict(enumerate(want))
    assert len(out) == len(rows)


def test_documents_of_the_small_table(spark, tools):
    from tidepool.llm.queries import op13_token_alignment

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    short = sorted(docs, key=lambda d: len(d[1] or ""))
    out = {r.doc_id: r for r in op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert len(out) == len(docs)
    # Links of long texts are many to compare one by one; the counts below need all of them, so all are plain.
    want = plain_fast(tools, [t for _, t in short])
    for (i, _), w in zip(short, want):
        assert tuple(out[i][c] for c in COLUMNS[:6]) == w


def plain_fast(tools, texts):
    """As plain, links by walking both sides."""
    a, b = tools
    of = ta.byte_level()
    links, shapes = [], []
    for text in texts:
        whole = f" {text or ''}".encode()
        left = [(i, len(bytes(of[c] for c in a.id_to_token(i)))) for i in a.encode(whole.decode(), add_special_tokens=False).ids]
        pieces = [(i, ta.piece_bytes(b.id_to_piece(i))) for i in b.encode(text or "")]
        if not text or b"".join(t for _, t in pieces) != whole:
            links.append([])
            shapes.append((0, 0, 0))
            continue
        right = [(i, len(t)) for i, t in pieces]
        x, y, at_x, at_y, own, common = 0, 0, left[0][1], right[0][1], [], 0
        while True:
            own.append((left[x][0], right[y][0]))
            common += at_x == at_y
            step_x, step_y = at_x <= at_y, at_y <= at_x
            if step_x:
                x += 1
            if step_y:
                y += 1
            if x == len(left):
                break
            at_x += left[x][1] if step_x else 0
            at_y += right[y][1] if step_y else 0
        links.append(own)
        shapes.append((len(left), len(right), common))
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(*s, len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own)) for own, s in zip(links, shapes)]


def test_empty_table_null_and_repeated_ids(spark, tools):
    schema = "doc_id long, text string"
    align = lambda rows: ta.align(spark.createDataFrame(rows, schema), tokenizer_path(A), tokenizer_path(B))
    assert align([]).collect() == []
    rows = [(None, "one two"), (7, "one two"), (7, "one two"), (7, None)]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in align(rows).collect())
    assert got == sorted(plain(tools, [t for _, t in rows]))


def test_heap_merge_counts_pairs_over_runs_and_frames():
    rng = np.random.default_rng(5)
    runs = ta.SpilledRuns(run_records=500, frame=16)
    count = Counter()
    for block in range(40):
        pair = np.sort(rng.integers(0, 200, 120))
        times = rng.integers(1, 5, 120)
        for p, t in zip(pair.tolist(), times.tolist()):
            count[p] += t
        runs.add(block, 1, ta._packed(pair, np.arange(120), times))
    runs.spill()
    assert len(runs.runs) > 3
    pairs, counts, best = runs.counted(10)
    assert dict(zip(pairs.tolist(), counts.tolist())) == count and pairs.tolist() == sorted(count)
    assert best.tolist() == [count[p] == max(c for q, c in count.items() if q // 10 == p // 10) for p in pairs.tolist()]
