"""Repairs against trying every edit, and against a plain table of costs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidepool.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
OK = re.compile("(s?(ua)+)?")


def damaged(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [] if fault == 0 else [(turn, role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best_of_all(rows, kinds):
    """Every edit of every row with every short insertion (few rows only)."""
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    own = []
    for (_, role, text), kind in zip(rows, kinds):
        extra = kind == "truncated"
        stay = [] if kind in ("blank", "duplicate") else [("K", extra, (role, text)), ("R", 2 + extra, ("user", text)), ("R", 2 + extra, ("assistant", text))]
        own.append([("D", 3, None), *stay])
    found = []
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*own):
            audit, cost, kept = "", 0, []
            for i, gap in enumerate(gaps):
                audit += "I" * len(gap)
                cost += 2 * len(gap)
                kept += [(r, "") for r in gap]
                if i < len(edits):
                    audit += edits[i][0]
                    cost += edits[i][1]
                    kept += [edits[i][2]] if edits[i][2] else []
            if OK.fullmatch("".join(r[:1] or "-" for r, _ in kept)):
                found.append((cost, audit, kept))
    return min(found)


def best_by_table(rows, kinds):
    """(cost, audit, kept) of the rest from each last role on, row by row from the end."""
    into = {"-": "u", "s": "u", "u": "a", "a": "u"}
    word = {"u": "user", "a": "assistant"}
    rest = {"-": (0, "", []), "a": (0, "", []), "s": (10**9, "", []), "u": (10**9, "", [])}

    def with_inserts(own):
        for _ in range(4):
            own = {q: min(own[q], (own[into[q]][0] + 2, "I" + own[into[q]][1], [(word[into[q]], ""), *own[into[q]][2]])) for q in own}
        return own

    rest = with_inserts(rest)
    for (_, role, text), kind in zip(rows[::-1], kinds[::-1]):
        extra, own = kind == "truncated", {}
        for q in rest:
            ways = [(rest[q][0] + 3, "D" + rest[q][1], rest[q][2])]
            if kind not in ("blank", "duplicate"):
                c, t, k = rest[into[q]]
                ways.append((c + 2 + extra, "R" + t, [(word[into[q]], text), *k]))
                if role[:1] == into[q] or q == "-" and role[:1] == "s":
                    c, t, k = rest[role[:1]]
                    ways.append((c + extra, "K" + t, [(role, text), *k]))
            own[q] = min(ways)
        rest = with_inserts(own)
    return rest["-"]


def expected(conv, rows, best):
    rows = damaged(rows)
    kinds = faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    cost, audit, kept = best(rows, kinds)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest


def made(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sudo"]
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", None, "Done. \n", "é.", "Yes."]
    start = rng.choice([0, -3, 2**62])
    return [(conv, rng.choice([start + i, start + rng.randrange(6), None]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def check(spark, convs, best, **kw):
    rows = [r for rows in convs.values() for r in rows]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], f"{SCHEMA}, cost string").repartition(5)
    out = cr.summaries(cr.damage(df), **kw).collect()
    assert len(out) == len(convs)
    for r in out:
        assert tuple(r) == expected(r.conv_id, convs[r.conv_id], best), damaged(convs[r.conv_id])


def test_short_conversations_against_all_edits(spark):
    rng = random.Random(3)
    check(spark, {c: made(rng, c, rng.choice([1, 2, 3])) for c in [*range(60), None]}, best_of_all)


@pytest.mark.parametrize("spill", [cr.SPILL_BYTES, 600])
def test_longer_conversations_spilled_or_not(spark, spill):
    rng = random.Random(4)
    check(spark, {c: made(rng, c, rng.randrange(1, 30)) for c in range(80)}, best_by_table, spill_bytes=spill)


def test_the_given_table(spark):
    from tidepool.llm.queries import op12_conversation_repair

    sf = "/root/testdata/sf0.01"
    convs = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    out = op12_conversation_repair(spark, sf).collect()
    assert len(out) == len(convs)
    for r in out:
        assert tuple(r) == expected(r.conv_id, convs[r.conv_id], best_by_table)


def test_giant_conversation_across_batches_and_chunks(spark):
    """A conversation with most rows: batches of 500 rows, many spilled chunks."""
    n = 30_000
    rows = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('line ', id, '.') AS text", "false AS dropped")
    small = spark.createDataFrame([(8, 0, "user", "Hi.", False), (8, 1, "assistant", "Ho.", False)], f"{SCHEMA}, dropped boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        out = {r.conv_id: r for r in cr.summaries(rows.union(small), spill_bytes=50_000).collect()}
        back = cr.repaired(rows.union(small), spill_bytes=50_000).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = "\n".join(f"{'assistant' if i % 2 else 'user'}:line {i}." for i in range(n))
    assert (out[7].cost, out[7].audit, out[7].repaired_sha256) == (0, "K" * n, hashlib.sha256(want.encode()).hexdigest())
    assert out[8].audit == "KK" and len(back) == n + 2
    assert "\n".join(f"{r.role}:{r.text}" for r in sorted((r for r in back if r.conv_id == 7), key=lambda r: r.position)) == want


def test_dropped_conversations_and_empty_tables(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = cr.summaries(cr.damage(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.summaries(cr.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_very_long_text_and_one_line_repeated(spark):
    rows = [(5, i, "user" if i % 2 else "assistant", "Same line.") for i in range(300)] + [(6, 1, "user", "x" * 3_000_000 + ".")]
    convs = {5: rows[:300], 6: rows[300:]}
    check(spark, convs, best_by_table)
