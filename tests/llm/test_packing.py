import zlib

import numpy as np
import pytest

from tidepool.llm.packing import WordIds, cut, marked_ranks, pack
from tidepool.llm.queries import tokenizer_path
from tidepool.llm.token_alignment import byte_level

TEXTS = [
    "", None, "  \t\n", "Plain words, it's 2024! don't", "a b c\x0bd\x1ce\x85f", "ΑΣ ΣΑΣ. é ́x ö̈",
    "x<|endoftext|>y <|startoftext|> z", "word " * 5000, "%%% ***a$$$ &&& 日本語テキスト 🙂🙂", "İstanbul ŒUVRE ǅ", "end, End. e., é, 1. x..", "ÀÉÎ ßÿ Öl, naïve ÇA µ ª º Ünïcödé ÿÿ", "<|ENDOFTEXT|> don't. 'S, it's,",
]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_word_ids_equal_whole_text_ids():
    whole = tokenizer()
    texts = [t or "" for t in TEXTS]
    got = WordIds(tokenizer_path()).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_least_ranks_merge_as_the_vocabulary_does():
    """Every token's bytes, merged by ranks below its own, end as the pair that its merge names."""
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks = marked_ranks({t: i for t, i in model["vocab"].items() if not t.startswith("<|")})
    of = byte_level()
    mark = lambda t: bytes(of[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>")
    seen = 0
    for pair in model["merges"]:
        a, b = map(mark, pair if isinstance(pair, list) else pair.split(" "))
        parts, rank = [bytes([c]) for c in a + b], ranks[a + b]
        while True:
            least, i = min((ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if least >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a, b]
        seen += 1
    assert seen > 48_000


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr("tidepool.llm.packing.CACHE_WORDS", 6)
    words, whole = WordIds(tokenizer_path()), tokenizer()
    for k in range(12):
        text = f"the a{k} b{k}, The c{k % 3}"
        assert np.frombuffer(words.encode([text.encode()])[0], "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("total", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_pieces_are_powers_of_two_without_gaps(total):
    got = list(cut(total))
    assert [s for s, _ in got] == np.cumsum([0] + [n for _, n in got])[:-1].tolist()
    assert sum(n for _, n in got) == total and all(n & (n - 1) == 0 and n <= 2048 for _, n in got)


def test_pack_round_trip(spark):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = pack(docs, tokenizer_path(), with_ids=True).toPandas()
    assert got["sequence_id"].is_unique and (got["offset"] == 0).all()
    whole, back = tokenizer(), {}
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        back.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(list(r.ids))
    for i, t, _ in rows[: len(TEXTS)]:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted((k[2], v) for k, v in back.items() if k[0] == i)
        assert all(len(v) == (2 if i == 3 else 1) for _, v in parts)
        assert sum((v[0] for _, v in parts), []) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs, tokenizer_path()).count() == 0
