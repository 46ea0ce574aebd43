"""Catalog queries: identity checks over people derived from ``customer``.

Each customer is one registered person (``pt_<key>``); customer keys also
plant second registrations (``pt_9<key>``) with a known relation, so the
checks can be scored against ground truth:

  key % 40 = 1  typo in the surname (two letters transposed)
  key % 40 = 3  day and month swapped (when the day is at most 12)
  key % 40 = 5  exact copy
  key % 40 = 7  nickname for the first name
  key % 40 = 9  new surname
  key % 40 = 11 a different person admitted under the same id
  key % 40 = 13 plain readmission (same details; not a candidate)
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.contracts import NICKNAMES
from tidepool.operators import identity as I
from tidepool.plans.registry import query
from tidepool.session import cut_lineage, ensure_checkpoint_dir
from tidepool.sources.tables import read_table

FIRST = tuple(n.capitalize() for n in NICKNAMES)
NICK = tuple(NICKNAMES[n][0].capitalize() for n in NICKNAMES)
LAST = ("Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez")
GENDERS = ("female", "male", "nonbinary")
DECIDED_AT = "2024-02-01 09:00:00"


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered people and their planted second admissions, from one scan."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    r = k % 40

    def born(key: Column) -> list[Column]:
        return [F.lit(1935) + (key * 7) % 86, F.lit(1) + (key * 5) % 12, F.lit(1) + (key * 11) % 28]

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.make_date(y, m, d).cast("string")

    def at(day: str) -> Column:
        return F.lit(day).cast("timestamp_ntz") + F.make_interval(mins=k.cast("int"))

    y, m, d = born(k)
    first, last = _pick(FIRST, k), _pick(LAST, F.floor(k / 10))
    own = F.concat(F.lit("pt_"), F.lpad(k.cast("string"), 6, "0"))
    typo = F.concat(F.substr(last, F.lit(1), F.lit(2)), F.substr(last, F.lit(4), F.lit(1)), F.substr(last, F.lit(3), F.lit(1)), F.substr(last, F.lit(5)))
    key = k.cast("string")

    def row(patient: Column, encounter: Column, ts: Column, name: Column, birth: Column) -> Column:
        return F.struct(
            patient.alias("patient_id"), encounter.alias("encounter_id"), ts.alias("event_ts"), name.alias("full_name"), birth.alias("birth_date"), _pick(GENDERS, k).alias("gender")
        )

    registered = row(own, F.concat(F.lit("enc_"), key), at("2024-01-01"), F.concat_ws(" ", first, last), date(y, m, d))
    again = row(
        F.concat(F.lit("pt_9"), F.lpad(key, 5, "0")),
        F.concat(F.lit("enc_9"), key),
        at("2024-01-02"),
        F.concat_ws(" ", F.when(r == 7, _pick(NICK, k)).otherwise(first), F.when(r == 1, typo).when(r == 9, _pick(LAST, F.floor(k / 10) + 3)).otherwise(last)),
        F.when(r == 3, date(y, d, m)).otherwise(date(y, m, d)),
    )
    k1 = k + 1
    other = row(own, F.concat(F.lit("enc_8"), key), at("2024-01-03"), F.concat_ws(" ", _pick(FIRST, k1), _pick(LAST, F.floor(k1 / 10) + 5)), date(*born(k1)))
    readmitted = row(own, F.concat(F.lit("enc_7enc_"), key), at("2024-01-04"), F.concat_ws(" ", first, last), date(y, m, d))
    planted = r.isin(1, 3, 5, 7, 9) & ~((r == 3) & (d > 12))
    rows = F.array(registered, F.when(planted, again), F.when(r == 11, other), F.when(r == 13, readmitted))
    return c.select(F.explode(F.array_compact(rows)).alias("a")).select("a.*")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admissions, written once for all that a query computes from them."""
    return cut_lineage(admissions(spark, sf_dir))


def checked(adm: DataFrame) -> DataFrame:
    """The candidates of the four checks, computed once."""
    return cut_lineage(I.candidates(adm))


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey"])
    k = F.col("c_custkey")
    r = k % 40
    d = F.lit(1) + (k * 11) % 28
    kind = (
        F.when(r == 5, "one_person_two_ids")
        .when(r.isin(1, 3), "one_person_two_ids_variant")
        .when(r.isin(7, 9), "one_person_two_ids_renamed")
    )
    return c.filter(r.isin(1, 3, 5, 7, 9) & ~((r == 3) & (d > 12))).select(
        kind.alias("kind"),
        F.concat(F.lit("pt_"), F.lpad(k.cast("string"), 6, "0")).alias("patient_id_a"),
        F.concat(F.lit("pt_9"), F.lpad(k.cast("string"), 5, "0")).alias("patient_id_b"),
    )


def truth_components(spark, sf_dir, pairs: DataFrame | None = None) -> DataFrame:
    pairs = truth_pairs(spark, sf_dir) if pairs is None else pairs
    return I.connected_components(pairs, "patient_id_a", "patient_id_b")


def pair_candidates(cands: DataFrame) -> DataFrame:
    c = cands.filter(F.size("patient_ids") == 2)
    return c.select("check", "key", F.get("patient_ids", 0).alias("patient_id_a"), F.get("patient_ids", 1).alias("patient_id_b"))


def decisions(spark, sf_dir, cands: DataFrame) -> DataFrame:
    """Steward decisions replayed from ground truth for the exact and fuzzy
    checks (name-change and shared-id candidates stay pending)."""
    open_checks = cands.filter(F.col("check").isin("exact_duplicate", "fuzzy_duplicate"))
    return I.replay_decisions(open_checks, truth_components(spark, sf_dir), "steward", DECIDED_AT)


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------
def _pick_sql(values, expr: str) -> str:
    return "(CASE (" + expr + ") % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


_K = "c_custkey"
_BASE = f"""base AS (
  SELECT c_custkey, 'pt_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS patient_id,
    {_pick_sql(FIRST, _K)} AS first, {_pick_sql(LAST, 'CAST(floor(c_custkey / 10) AS BIGINT)')} AS last,
    1935 + (c_custkey * 7) % 86 AS y, 1 + (c_custkey * 5) % 12 AS m, 1 + (c_custkey * 11) % 28 AS d,
    {_pick_sql(GENDERS, _K)} AS gender
  FROM customer)"""
ADM_SQL = _BASE + f""",
adm AS (
  SELECT patient_id, 'enc_' || CAST(c_custkey AS VARCHAR) AS encounter_id,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(c_custkey AS INTEGER) AS event_ts,
    first || ' ' || last AS full_name, CAST(make_date(y, m, d) AS VARCHAR) AS birth_date, gender
  FROM base
  UNION ALL
  SELECT 'pt_9' || lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 'enc_9' || CAST(c_custkey AS VARCHAR),
    TIMESTAMP '2024-01-02 00:00:00' + INTERVAL 1 MINUTE * CAST(c_custkey AS INTEGER),
    CASE WHEN c_custkey % 40 = 7 THEN {_pick_sql(NICK, _K)} ELSE first END || ' ' ||
    CASE WHEN c_custkey % 40 = 1 THEN substr(last, 1, 2) || substr(last, 4, 1) || substr(last, 3, 1) || substr(last, 5)
         WHEN c_custkey % 40 = 9 THEN {_pick_sql(LAST, 'CAST(floor(c_custkey / 10) AS BIGINT) + 3')} ELSE last END,
    CAST(CASE WHEN c_custkey % 40 = 3 THEN make_date(y, d, m) ELSE make_date(y, m, d) END AS VARCHAR), gender
  FROM base WHERE c_custkey % 40 IN (1, 3, 5, 7, 9) AND NOT (c_custkey % 40 = 3 AND d > 12)
  UNION ALL
  SELECT patient_id, 'enc_8' || CAST(c_custkey AS VARCHAR),
    TIMESTAMP '2024-01-03 00:00:00' + INTERVAL 1 MINUTE * CAST(c_custkey AS INTEGER),
    {_pick_sql(FIRST, 'c_custkey + 1')} || ' ' || {_pick_sql(LAST, 'CAST(floor((c_custkey + 1) / 10) AS BIGINT) + 5')},
    CAST(make_date(1935 + ((c_custkey + 1) * 7) % 86, 1 + ((c_custkey + 1) * 5) % 12, 1 + ((c_custkey + 1) * 11) % 28) AS VARCHAR), gender
  FROM base WHERE c_custkey % 40 = 11
  UNION ALL
  SELECT patient_id, 'enc_7enc_' || CAST(c_custkey AS VARCHAR),
    TIMESTAMP '2024-01-04 00:00:00' + INTERVAL 1 MINUTE * CAST(c_custkey AS INTEGER),
    first || ' ' || last, CAST(make_date(y, m, d) AS VARCHAR), gender
  FROM base WHERE c_custkey % 40 = 13),
truth AS (
  SELECT CASE WHEN c_custkey % 40 = 5 THEN 'one_person_two_ids' WHEN c_custkey % 40 IN (1, 3) THEN 'one_person_two_ids_variant'
              ELSE 'one_person_two_ids_renamed' END AS kind,
    'pt_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS patient_id_a, 'pt_9' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS patient_id_b
  FROM base WHERE c_custkey % 40 IN (1, 3, 5, 7, 9) AND NOT (c_custkey % 40 = 3 AND d > 12))"""

NICK_SQL = "nick(first_name, formal_first_name) AS (VALUES " + ", ".join(
    f"('{n}', '{f}')" for f, ns in NICKNAMES.items() for n in ns
) + ")"

CHECKS_SQL = ADM_SQL + ",\n" + NICK_SQL + r""",
ppl AS (SELECT DISTINCT patient_id, lower(full_name) AS name, birth_date, gender FROM adm),
fz_p AS (SELECT *, gender || '|' || substr(birth_date, 1, 4) || '|' || least(substr(birth_date, 6, 2), substr(birth_date, 9, 2))
                 || '-' || greatest(substr(birth_date, 6, 2), substr(birth_date, 9, 2)) AS block FROM ppl),
fuzzy AS (
  SELECT a.patient_id AS patient_id_a, b.patient_id AS patient_id_b, CAST(levenshtein(a.name, b.name) AS INTEGER) AS name_edit_distance,
         CASE WHEN a.birth_date = b.birth_date THEN 'same' ELSE 'day and month swapped' END AS birth_date_match
  FROM fz_p a JOIN fz_p b ON a.block = b.block AND a.patient_id < b.patient_id
  WHERE levenshtein(a.name, b.name) <= 2 AND NOT (levenshtein(a.name, b.name) = 0 AND a.birth_date = b.birth_date)),
nc_s AS (SELECT *, regexp_extract(name, '^(\S+)', 1) AS first_name, regexp_extract(name, '^\S+\s+(.*)$', 1) AS last_name FROM ppl),
nc_p AS (SELECT nc_s.*, gender || '|' || birth_date || '|' || coalesce(k.formal_first_name, nc_s.first_name) AS block
         FROM nc_s LEFT JOIN nick k USING (first_name)),
namechg AS (
  SELECT a.patient_id AS patient_id_a, b.patient_id AS patient_id_b, CAST(levenshtein(a.name, b.name) AS INTEGER) AS name_edit_distance,
         CASE WHEN a.last_name = b.last_name THEN 'nickname' WHEN a.first_name = b.first_name THEN 'surname changed'
              ELSE 'nickname and surname changed' END AS match_reason
  FROM nc_p a JOIN nc_p b ON a.block = b.block AND a.patient_id < b.patient_id
  WHERE levenshtein(a.name, b.name) > 2),
conf AS (
  SELECT patient_id, count(DISTINCT encounter_id) AS admissions, count(DISTINCT full_name) AS names,
         count(DISTINCT birth_date) AS birth_dates, count(DISTINCT gender) AS genders,
         min(event_ts) AS first_admitted, max(event_ts) AS last_admitted
  FROM adm GROUP BY patient_id HAVING count(DISTINCT encounter_id) > 1),
exact_g AS (SELECT full_name, birth_date, min(patient_id) AS mn, count(DISTINCT patient_id) AS n FROM adm GROUP BY full_name, birth_date),
exact_e AS (SELECT DISTINCT g.mn AS patient_id_a, a.patient_id AS patient_id_b FROM adm a JOIN exact_g g USING (full_name, birth_date)
            WHERE g.n > 1 AND a.patient_id <> g.mn),
cands AS (
  SELECT 'two_people_one_id' AS "check", patient_id AS ids, CAST(admissions AS VARCHAR) || ' admissions' AS detail FROM conf
    WHERE names > 1 OR birth_dates > 1
  UNION ALL SELECT 'exact_duplicate', patient_id_a || ',' || patient_id_b, 'same name and birth date' FROM exact_e
  UNION ALL SELECT 'fuzzy_duplicate', patient_id_a || ',' || patient_id_b,
      'name ' || CAST(name_edit_distance AS VARCHAR) || ' edit(s) apart; birth date ' || birth_date_match FROM fuzzy
  UNION ALL SELECT 'name_change', patient_id_a || ',' || patient_id_b, match_reason FROM namechg),
pairs AS (SELECT "check", ids AS key, split_part(ids, ',', 1) AS patient_id_a, split_part(ids, ',', 2) AS patient_id_b
          FROM cands WHERE "check" <> 'two_people_one_id')
"""


def _components_sql(edges: str, name: str) -> str:
    return f"""{name}_e AS (SELECT patient_id_a AS s, patient_id_b AS d FROM {edges} UNION SELECT patient_id_b, patient_id_a FROM {edges}),
{name}_r AS (SELECT s AS id, s AS lbl FROM {name}_e UNION SELECT e.d, r.lbl FROM {name}_r r JOIN {name}_e e ON e.s = r.id),
{name} AS (SELECT id, min(lbl) AS component FROM {name}_r GROUP BY id)"""


def _with_recursive(body_ctes: str) -> str:
    return "WITH RECURSIVE " + body_ctes


TRUTH_COMP = _components_sql("truth", "tc")
DECISIONS_SQL = f""",
{TRUTH_COMP},
dec_ids AS (SELECT key, patient_id_a AS id FROM pairs WHERE "check" IN ('exact_duplicate', 'fuzzy_duplicate')
            UNION SELECT key, patient_id_b FROM pairs WHERE "check" IN ('exact_duplicate', 'fuzzy_duplicate')),
decisions AS (
  SELECT key AS patient_ids,
         CASE WHEN count(DISTINCT coalesce(tc.component, dec_ids.id)) = 1 AND count(*) = 2 THEN 'same_person' ELSE 'different_people' END AS decision,
         'steward' AS decided_by, TIMESTAMP '{DECIDED_AT}' AS decided_at, 'replayed from ground truth' AS note
  FROM dec_ids LEFT JOIN tc ON tc.id = dec_ids.id GROUP BY key)
"""


@query("identity_conflicts", "WITH " + CHECKS_SQL + "SELECT * FROM conf")
def q_identity_conflicts(spark, sf_dir):
    return I.identity_conflicts(admissions(spark, sf_dir))


@query(
    "exact_duplicates",
    "WITH " + ADM_SQL + """ SELECT sha256(full_name || '|' || birth_date) AS match_key, count(DISTINCT patient_id) AS patient_ids,
       array_to_string(list_sort(list(DISTINCT patient_id)), ',') AS candidate_patient_ids, count(*) AS admissions
    FROM adm GROUP BY full_name, birth_date HAVING count(DISTINCT patient_id) > 1""",
)
def q_exact_duplicates(spark, sf_dir):
    out = I.exact_duplicates(admissions(spark, sf_dir))
    return out.withColumn("candidate_patient_ids", F.array_join("candidate_patient_ids", ","))


@query("fuzzy_duplicates", "WITH " + CHECKS_SQL + "SELECT * FROM fuzzy")
def q_fuzzy_duplicates(spark, sf_dir):
    return I.fuzzy_duplicates(admissions(spark, sf_dir))


@query("name_change", "WITH " + CHECKS_SQL + "SELECT * FROM namechg")
def q_name_change(spark, sf_dir):
    return I.name_change(admissions(spark, sf_dir))


@query("identity_candidates", "WITH " + CHECKS_SQL + 'SELECT "check", ids, detail FROM cands')
def q_identity_candidates(spark, sf_dir):
    c = I.candidates(people(spark, sf_dir))
    return c.select("check", F.col("key").alias("ids"), "detail")


@query("explode_pairs", "WITH " + CHECKS_SQL + "SELECT patient_id_a, patient_id_b FROM exact_e")
def q_explode_pairs(spark, sf_dir):
    return I.exact_duplicate_edges(admissions(spark, sf_dir))


@query(
    "connected_components",
    _with_recursive(CHECKS_SQL + ",\n" + _components_sql("pairs", "cc") + "\nSELECT id, component FROM cc"),
)
def q_connected_components(spark, sf_dir):
    p = pair_candidates(I.candidates(people(spark, sf_dir)))
    return I.connected_components(p, "patient_id_a", "patient_id_b")


@query(
    "replay_decisions",
    _with_recursive(CHECKS_SQL + DECISIONS_SQL + "SELECT patient_ids, decision, decided_by, decided_at, note FROM decisions"),
)
def q_replay_decisions(spark, sf_dir):
    return decisions(spark, sf_dir, I.candidates(people(spark, sf_dir)))


@query(
    "validate_decisions",
    _with_recursive(
        CHECKS_SQL + DECISIONS_SQL + """, spoilt AS (
      SELECT right(patient_ids, 1) AS d, CASE right(patient_ids, 1) WHEN '2' THEN patient_ids || ' , pt_0' WHEN '3' THEN replace(patient_ids, 'pt_', 'x')
        ELSE patient_ids END AS ids FROM decisions)
    SELECT array_to_string(list_sort(string_split(replace(ids, ' ', ''), ',')), ',') AS key, d NOT IN ('0', '1', '2', '3') AS is_valid,
      CASE d WHEN '0' THEN 'unknown decision' WHEN '1' THEN 'missing decider' WHEN '2' THEN 'needs one or two ids' WHEN '3' THEN 'bad id prefix' ELSE '' END AS problems
    FROM spoilt"""
    ),
)
def q_validate_decisions(spark, sf_dir):
    """Decisions with a fault for four of ten last digits of their ids."""
    last, ids = F.right("patient_ids", F.lit(1)), F.col("patient_ids")
    spoilt = decisions(spark, sf_dir, I.candidates(people(spark, sf_dir))).select(
        F.when(last == "2", F.concat(ids, F.lit(" , pt_0"))).when(last == "3", F.replace(ids, F.lit("pt_"), F.lit("x"))).otherwise(ids).alias("patient_ids"),
        F.when(last == "0", "maybe").otherwise(F.col("decision")).alias("decision"),
        F.when(last == "1", "  ").otherwise(F.col("decided_by")).alias("decided_by"),
    )
    v = I.validate_decisions(spoilt)
    return v.select("key", "is_valid", F.array_join("problems", ",").alias("problems"))


_SAME_PAIRS = "same_pairs AS (SELECT split_part(patient_ids, ',', 1) AS patient_id_a, split_part(patient_ids, ',', 2) AS patient_id_b FROM decisions WHERE decision = 'same_person')"


@query(
    "person_map",
    _with_recursive(
        CHECKS_SQL + DECISIONS_SQL + ",\n" + _SAME_PAIRS + ",\n" + _components_sql("same_pairs", "pm")
        + """\nSELECT p.patient_id, coalesce(pm.component, p.patient_id) AS person_key,
           coalesce(pm.component, p.patient_id) <> p.patient_id AS steward_merged
        FROM (SELECT DISTINCT patient_id FROM adm) p LEFT JOIN pm ON pm.id = p.patient_id"""
    ),
)
def q_person_map(spark, sf_dir):
    adm = people(spark, sf_dir)
    return I.person_map(adm.select("patient_id").distinct(), decisions(spark, sf_dir, I.candidates(adm)))


@query(
    "review_queue",
    _with_recursive(CHECKS_SQL + DECISIONS_SQL + """SELECT "check", ids AS key, detail FROM cands
        WHERE ids NOT IN (SELECT patient_ids FROM decisions)"""),
)
def q_review_queue(spark, sf_dir):
    c = checked(people(spark, sf_dir))
    return I.review_queue(c, decisions(spark, sf_dir, c)).select("check", "key", "detail")


@query(
    "review_summary",
    _with_recursive(CHECKS_SQL + DECISIONS_SQL + """SELECT c."check", count(*) AS candidates, count(*) FILTER (WHERE d.decision IS NULL) AS pending,
        count(*) FILTER (WHERE d.decision = 'same_person') AS same_person,
        count(*) FILTER (WHERE d.decision = 'different_people') AS different_people
      FROM (SELECT DISTINCT "check", ids FROM cands) c LEFT JOIN decisions d ON d.patient_ids = c.ids GROUP BY c."check" """),
)
def q_review_summary(spark, sf_dir):
    c = checked(people(spark, sf_dir))
    return I.review_summary(c, decisions(spark, sf_dir, c))


@query(
    "identity_score",
    _with_recursive(CHECKS_SQL + DECISIONS_SQL + """, fl AS (SELECT DISTINCT patient_id_a, patient_id_b FROM pairs)
      SELECT t.kind, count(*) AS planted,
             count(*) FILTER (WHERE EXISTS (SELECT 1 FROM fl WHERE fl.patient_id_a = t.patient_id_a AND fl.patient_id_b = t.patient_id_b)) AS caught,
             count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.patient_id_a = t.patient_id_a AND fl.patient_id_b = t.patient_id_b)) AS missed
      FROM truth t GROUP BY t.kind
      UNION ALL
      SELECT 'not_planted', 0, count(*), 0 FROM fl
        LEFT JOIN tc ca ON ca.id = fl.patient_id_a LEFT JOIN tc cb ON cb.id = fl.patient_id_b
      WHERE NOT coalesce(ca.component = cb.component, false)"""),
)
def q_identity_score(spark, sf_dir):
    flagged = pair_candidates(checked(people(spark, sf_dir)))
    truth = cut_lineage(truth_pairs(spark, sf_dir))
    return I.score_checks(flagged, truth, truth_components(spark, sf_dir, truth))


@query(
    "closure_pairs",
    _with_recursive(ADM_SQL + ",\n" + TRUTH_COMP + """
      SELECT component, count(*) AS ids, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM tc GROUP BY component"""),
)
def q_closure_pairs(spark, sf_dir):
    """Pairs inside each truth group, counted from the group size (never
    materialised): size * (size - 1) / 2."""
    comp = truth_components(spark, sf_dir)
    g = comp.groupBy("component").agg(F.count(F.lit(1)).alias("ids"))
    return g.withColumn("pairs", (F.col("ids") * (F.col("ids") - 1) / 2).cast("bigint"))


@query(
    "identity_summary",
    _with_recursive(CHECKS_SQL + DECISIONS_SQL + ",\n" + _SAME_PAIRS + ",\n" + _components_sql("same_pairs", "pm") + ",\n"
        + _components_sql("pairs", "cc") + """
      SELECT 'flagged_ids' AS measure, (SELECT count(*) FROM conf WHERE names > 1 OR birth_dates > 1) AS value
      UNION ALL SELECT 'groups', (SELECT count(DISTINCT component) FROM cc)
      UNION ALL SELECT 'ids_involved', (SELECT count(*) FROM cc)
      UNION ALL SELECT 'pairs', (SELECT count(*) FROM (SELECT DISTINCT patient_id_a, patient_id_b FROM pairs))
      UNION ALL SELECT 'people', (SELECT count(DISTINCT coalesce(pm.component, p.patient_id)) FROM (SELECT DISTINCT patient_id FROM adm) p
                LEFT JOIN pm ON pm.id = p.patient_id)"""),
)
def q_identity_summary(spark, sf_dir):
    """Snapshot counts in long form (measure, value): one small aggregate per
    measure, unioned."""
    adm = people(spark, sf_dir)
    cands = I.candidates(adm)  # not written: the pairs of a block are as many as its square
    p = pair_candidates(cands)
    cc = I.connected_components(p, "patient_id_a", "patient_id_b")
    persons = I.person_map(adm.select("patient_id").distinct(), decisions(spark, sf_dir, cands))
    parts = [
        I.shared_ids(adm).agg(F.lit("flagged_ids").alias("measure"), F.count(F.lit(1)).alias("value")),
        cc.agg(F.lit("groups").alias("measure"), F.count_distinct("component").alias("value")),
        cc.agg(F.lit("ids_involved").alias("measure"), F.count(F.lit(1)).alias("value")),
        I.distinct_pairs(p).select(F.lit("pairs").alias("measure"), F.col("pairs").alias("value")),
        persons.agg(F.lit("people").alias("measure"), F.count_distinct("person_key").alias("value")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query(
    "publish_decisions",
    _with_recursive(CHECKS_SQL + DECISIONS_SQL + "SELECT patient_ids, decision, decided_by, decided_at, note FROM decisions"),
)
def q_publish_decisions(spark, sf_dir):
    """Replace a decisions table of this run's own (in the shared checkpoint
    folder) with the current decisions, then read it back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/identity_decisions-{uuid.uuid4().hex}"
    decisions(spark, sf_dir, I.candidates(people(spark, sf_dir))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
