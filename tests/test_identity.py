import random

from pyspark.sql import functions as F

from tidepool.operators import identity as I
from tidepool.plans import identity

ADM = "patient_id string, encounter_id string, event_ts timestamp_ntz, full_name string, birth_date string, gender string"


def admissions(spark):
    rows = [
        ("p1", "e1", "Mary Smith", "1980-01-02", "female"),
        ("p1", "e2", "Robert Jones", "1955-07-08", "male"),
        ("p2", "e3", "Ann Lee", "1990-05-05", "female"),
        ("p2", "e4", "Ann Lee", "1990-05-05", "female"),
        ("p3", "e5", "Tom Hill", "1970-01-01", "male"),
        ("p4", "e6", "Tom Hill", "1970-01-01", "male"),
        ("p5", "e7", "Linda Garcia", "1960-02-02", "female"),
        ("p6", "e8", "Linda Gacria", "1960-02-02", "female"),
        ("p7", "e9", "Paul King", "1970-03-04", "male"),
        ("p8", "e10", "Paul King", "1970-04-03", "male"),
        ("p9", "e11", "Robert Brown", "1950-06-06", "male"),
        ("p10", "e12", "Bob Brown", "1950-06-06", "male"),
        ("p11", "e13", "Susan Davis", "1965-09-09", "female"),
        ("p12", "e14", "Susan Martinez", "1965-09-09", "female"),
    ]
    return spark.createDataFrame([(a, b, None, c, d, e) for a, b, c, d, e in rows], ADM)


def test_checks_on_fixture(spark):
    a = admissions(spark)
    shared = {r.patient_id for r in I.shared_ids(a).collect()}
    assert shared == {"p1"}  # p2 is a plain readmission
    exact = [sorted(r.candidate_patient_ids) for r in I.exact_duplicates(a).collect()]
    assert exact == [["p3", "p4"]]
    fuzzy = {(r.patient_id_a, r.patient_id_b): (r.name_edit_distance, r.birth_date_match) for r in I.fuzzy_duplicates(a).collect()}
    assert fuzzy[("p5", "p6")] == (2, "same")
    assert fuzzy[("p7", "p8")] == (0, "day and month swapped")
    nc = {(r.patient_id_a, r.patient_id_b): r.match_reason for r in I.name_change(a).collect()}
    assert nc[("p10", "p9")] == "nickname"
    assert nc[("p11", "p12")] == "surname changed"


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_deletion_neighbourhood_finds_every_close_pair(spark):
    rng = random.Random(11)
    base = ["anna bell", "ann bell", "anna bel", "nna bell", "john doe", "jon doe", "john deo", "jane doe", "ab", "abc", "ba"]
    names = base + ["".join(rng.choice("abn ") for _ in range(rng.randint(2, 7))) for _ in range(40)]
    rows = [(f"id{i:03d}", None, None, n, "1970-01-01", "x") for i, n in enumerate(names)]
    a = spark.createDataFrame(rows, ADM)
    people = sorted(set((f"id{i:03d}", n.lower()) for i, n in enumerate(names)))
    want = {(x, y) for (x, nx), (y, ny) in __import__("itertools").combinations(people, 2) if 0 < _lev(nx, ny) <= 2}
    got = {(r.patient_id_a, r.patient_id_b) for r in I.fuzzy_duplicates(a).collect()}
    assert got == want


def test_components_chain_and_person_map(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "d")], "src string, dst string")
    comp = {r.id: r.component for r in I.connected_components(edges).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    dec = spark.createDataFrame(
        [("pt_b,pt_a", "same_person", "s", "2026-01-01 00:00:00", ""), ("pt_c, pt_b", "same_person", "s", "2026-01-01 00:00:00", ""),
         ("pt_e", "same_person", "s", "2026-01-01 00:00:00", ""), ("pt_d,pt_e", "maybe", "s", "2026-01-01 00:00:00", ""),
         ("x_d,pt_e", "same_person", "s", "2026-01-01 00:00:00", "")],
        "patient_ids string, decision string, decided_by string, decided_at string, note string",
    ).withColumn("decided_at", F.col("decided_at").cast("timestamp_ntz"))
    pats = spark.createDataFrame([("pt_" + p,) for p in "abcde"], "patient_id string")
    pm = {r.patient_id[3:]: (r.person_key[3:], r.steward_merged) for r in I.person_map(pats, dec).collect()}
    assert pm == {"a": ("a", False), "b": ("a", True), "c": ("a", True), "d": ("d", False), "e": ("e", False)}
    v = {r.key: r.is_valid for r in I.validate_decisions(dec).collect()}
    assert v["pt_b,pt_c"] and not v["pt_d,pt_e"] and not v["pt_e,x_d"]


def test_two_copies_are_not_false_alarms(spark):
    truth = spark.createDataFrame([("k", "a", "b"), ("k", "a", "c")], "kind string, patient_id_a string, patient_id_b string")
    comps = I.connected_components(truth, "patient_id_a", "patient_id_b")
    flagged = spark.createDataFrame([("b", "c")], "patient_id_a string, patient_id_b string")
    s = {r.kind: (r.planted, r.caught, r.missed) for r in I.score_checks(flagged, truth, comps).collect()}
    assert s["not_planted"][1] == 0 and s["k"] == (2, 0, 2)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)], "src string, dst string")
    assert {r.component for r in I.connected_components(edges).collect()} == {"n0000"}


def test_near_names_of_small_and_large_blocks_agree(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    rows = [("large", n) for n in names] + [("small", n) for n in names[:7]] + [("one", "ab"), ("one", None)]
    people = spark.createDataFrame(rows, "block string, name string")
    want = {(k, x, y, _lev(x, y)) for k, x in rows for j, y in rows if x and y and k == j and x <= y and _lev(x, y) <= 2}
    for few in (0, 7, 100):
        got = [tuple(r) for r in I.near_names(people, few).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_people_are_not_broadcast(spark, tmp):
    # Plan statistics take rows made by generators for as many as went in.
    spark.range(300).selectExpr("id AS c_custkey").write.parquet(f"{tmp}/customer.parquet")
    a = identity.admissions(spark, tmp)
    for found in (I.fuzzy_duplicates(a), I.exact_duplicate_edges(a)):
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_labels_decisions_and_pairs_are_not_broadcast(spark):
    pairs = spark.createDataFrame([(f"pt_{i:02d}", f"pt_{i + 1:02d}") for i in range(0, 20, 2)], "patient_id_a string, patient_id_b string")
    comps = I.connected_components(pairs, "patient_id_a", "patient_id_b")
    cands = pairs.select(F.lit("c").alias("check"), F.array("patient_id_a", "patient_id_b").alias("patient_ids"), F.concat_ws(",", "patient_id_a", "patient_id_b").alias("key"))
    decided = I.replay_decisions(cands, comps, "s", "2026-01-01 00:00:00")
    truth = pairs.withColumn("kind", F.lit("k"))
    people = pairs.select(F.col("patient_id_b").alias("patient_id"))
    found = {
        "replay": decided,
        "person_map": I.person_map(people, decided),
        "queue": I.review_queue(cands, decided),
        "summary": I.review_summary(cands, decided),
        "inside": I.in_same_component(pairs, comps),
    }
    for name, df in found.items():
        rows = df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString(), name
        assert len(rows) == {"queue": 0, "summary": 1}.get(name, 10)
    score = I.score_checks(pairs, truth, comps)
    assert {tuple(r) for r in score.collect()} == {("k", 10, 10, 0), ("not_planted", 0, 0, 0)}
    assert score._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 3


def test_component_rounds_broadcast_nothing(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(9)], "src string, dst string")
    joins = []
    real = type(edges).checkpoint

    def seen(df, *a, **k):
        # Adaptive execution turns other joins into broadcasts while they run.
        joins.extend(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x)
        return real(df, *a, **k)

    monkeypatch.setattr(type(edges), "checkpoint", seen)
    assert {r.component for r in I.connected_components(edges).collect()} == {"n00"}
    assert joins and all("strategy=merge" in x for x in joins)


def test_links_become_stars_of_the_same_components(spark, monkeypatch):
    import pyarrow as pa

    from tidepool.operators import identity as I

    rng = random.Random(6)
    clique = [(f"c{i}", f"c{j}") for i in range(30) for j in range(i)]
    loose = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(40)]
    chain = [(f"z{i:03d}", f"z{i + 1:03d}") for i in range(50)]
    links = [*clique, *loose, *chain, *clique]
    rng.shuffle(links)
    for most in (10_000, 7):
        monkeypatch.setattr(I, "LINKS", 100)
        monkeypatch.setattr(I, "STARS", most)
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in links[k : k + 33]]) for i in (0, 1)], ["a", "b"]) for k in range(0, len(links), 33)]
        stars = [(a, b) for r in I._stars(iter(batches)) for a, b in zip(*(r.column(c).to_pylist() for c in "ab"))]
        if most > 100:  # a pair of the clique's 435 goes no further
            assert len(stars) < len({x for link in links for x in link})
        got, want = ({r.id: r.component for r in I.connected_components(spark.createDataFrame(x, "src string, dst string")).collect()} for x in (stars, links))
        assert got == want and want["c9"] == "c0" and want["z050"] == "z000"


def test_distinct_pairs_are_counted_from_lists(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidepool.operators import identity as I

    rng = random.Random(7)
    pairs = [(f"a{rng.randint(0, 9)}", f"b{rng.randint(0, 40)}") for _ in range(900)] + [("hot", f"b{i % 300}") for i in range(700)]
    df = spark.createDataFrame(pairs, "patient_id_a string, patient_id_b string").repartition(5)
    monkeypatch.setattr(I, "LINKS", 64)
    assert I.distinct_pairs(df).collect() == [(len(set(pairs)),)]
    assert I.distinct_pairs(df.where(F.lit(False))).collect() == [(0,)]


def test_summary_does_not_write_the_candidates(spark, monkeypatch, tmp):
    from tidepool.operators import identity as I
    from tidepool.plans import identity as P

    spark.range(400).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp}/customer.parquet")
    written, real = [], P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    got = {r.measure: r.value for r in P.q_identity_summary(spark, tmp).collect()}
    assert not [c for c in written if "patient_ids" in c]
    pairs = P.pair_candidates(I.candidates(P.admissions(spark, tmp))).select("patient_id_a", "patient_id_b").distinct()
    assert got["pairs"] == pairs.count() > 0 and pairs.where("patient_id_a >= patient_id_b").isEmpty()
