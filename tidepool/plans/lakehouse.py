"""Catalog queries: the event path from raw to Gold (CDC, joins, live rollup)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.contracts import ALERT_BANDS, UNASSIGNED_UNIT
from tidepool.operators import cdc, live
from tidepool.operators.joins import asof_interval_join
from tidepool.plans import sql as S
from tidepool.plans import views as V
from tidepool.plans.registry import query

AS_OF_TS = "2024-01-15 12:00:00"


def live_vitals_by_unit(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """gold_live_vitals_by_unit: heart-rate readings attributed to the unit in
    effect at reading time (as-of join to the history), 15-minute windows.

    With ``since`` or ``until`` only readings that windows starting in [since,
    until) can hold are read - the bound reaches the scan, which a condition on
    the windows cannot. The caller still filters the windows."""
    readings = V.fct_vitals(spark, sf_dir).filter(F.col("itemid") == "heart_rate").select("encounter_id", "event_ts", "value")
    if since:
        readings = readings.filter(F.col("event_ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        readings = readings.filter(F.col("event_ts") < F.lit(until).cast("timestamp_ntz") + F.expr("INTERVAL 15 MINUTES"))
    hist = V.encounter_history(spark, sf_dir).select("encounter_id", "unit", "valid_from", "valid_to")
    joined = asof_interval_join(readings, hist, "encounter_id", "event_ts", "encounter_id", "valid_from", "valid_to", ["unit"])
    joined = joined.withColumn("unit", F.coalesce("unit", F.lit(UNASSIGNED_UNIT)))
    return live.window_rollup(joined, "event_ts", ["unit"], "value", ALERT_BANDS["heart_rate"], avg_alias="avg_heart_rate")


@query(
    "live_window_agg",
    S.with_(S.EV, S.CDC, S.HIST, S.VIT, S.LIVE)
    + "SELECT window_start, window_end, unit, round(avg_heart_rate, 6) AS avg_heart_rate, out_of_range_count, reading_count FROM live",
)
def q_live_window_agg(spark, sf_dir):
    return live_vitals_by_unit(spark, sf_dir).withColumn("avg_heart_rate", F.round("avg_heart_rate", 6))


@query(
    "scd2_history",
    S.with_(S.EV, S.CDC, S.HIST)
    + "SELECT encounter_id, patient_id, encounter_type, unit, attending_provider_id, status, valid_from, valid_to FROM hist",
)
def q_scd2_history(spark, sf_dir):
    return V.encounter_history(spark, sf_dir)


@query(
    "scd1_partial",
    S.with_(S.EV, S.CDC, S.CUR)
    + "SELECT encounter_id, event_ts, patient_id, encounter_type, unit, attending_provider_id, status FROM cur",
)
def q_scd1_partial(spark, sf_dir):
    return V.encounters_current(spark, sf_dir)


@query(
    "scd1_patients",
    S.with_(S.EV, S.ADM, S.PAT) + "SELECT patient_id, event_ts, mrn, full_name, birth_date, gender, region FROM pat",
)
def q_scd1_patients(spark, sf_dir):
    return V.patients_current(spark, sf_dir)


@query(
    "scd1_latest",
    """SELECT user_id, arg_max(ts, struct_pack(t := ts, i := event_id)) AS ts,
       arg_max(event_type, struct_pack(t := ts, i := event_id)) AS event_type,
       arg_max(value, struct_pack(t := ts, i := event_id)) AS value,
       arg_max(props, struct_pack(t := ts, i := event_id)) AS props
    FROM events GROUP BY user_id""",
)
def q_scd1_latest(spark, sf_dir):
    ev = V.events(spark, sf_dir)
    return cdc.scd1_latest(ev, ["user_id"], "ts", ["event_type", "value", "props"], tiebreak="event_id")


@query(
    "asof_interval_join",
    S.with_(S.EV, S.CDC, S.HIST, S.VIT)
    + """SELECT v.event_id, v.encounter_id, v.event_ts, v.itemid, v.value,
       COALESCE(h.unit, 'UNASSIGNED') AS unit, h.status
    FROM vit v LEFT JOIN hist h ON v.encounter_id = h.encounter_id AND v.event_ts >= h.valid_from
       AND (h.valid_to IS NULL OR v.event_ts < h.valid_to)""",
)
def q_asof_interval_join(spark, sf_dir):
    readings = V.fct_vitals(spark, sf_dir).select("event_id", "encounter_id", "event_ts", "itemid", "value")
    hist = V.encounter_history(spark, sf_dir)
    out = asof_interval_join(readings, hist, "encounter_id", "event_ts", "encounter_id", "valid_from", "valid_to", ["unit", "status"])
    return out.withColumn("unit", F.coalesce("unit", F.lit(UNASSIGNED_UNIT)))


@query(
    "census_as_of",
    S.with_(S.EV, S.CDC, S.HIST)
    + f"""SELECT encounter_id, patient_id, unit, status, valid_from, valid_to FROM hist
    WHERE valid_from <= TIMESTAMP '{AS_OF_TS}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF_TS}')""",
)
def q_census_as_of(spark, sf_dir):
    snap = cdc.as_of(V.encounter_history(spark, sf_dir), AS_OF_TS)
    return snap.select("encounter_id", "patient_id", "unit", "status", "valid_from", "valid_to")


@query(
    "history_project",
    S.with_(S.EV, S.CDC, S.HIST)
    + "SELECT encounter_id, patient_id, encounter_type, unit, attending_provider_id, status, valid_from, valid_to FROM hist WHERE status IS NOT NULL",
)
def q_history_project(spark, sf_dir):
    """fct_encounter_history as published: validity renamed, versions with a status."""
    return V.encounter_history(spark, sf_dir).filter(F.col("status").isNotNull())


@query(
    "cdc_flatten",
    S.with_(S.EV, S.CDC) + "SELECT encounter_id, patient_id, event_ts, event_id, event_type, encounter_type, unit, attending_provider_id, status FROM cdc",
)
def q_cdc_flatten(spark, sf_dir):
    return V.cdc_feed(spark, sf_dir)


@query(
    "vitals_project",
    S.with_(S.EV, S.VIT) + "SELECT event_id, event_ts, patient_id, encounter_id, itemid, value, valueuom FROM vit_all",
)
def q_vitals_project(spark, sf_dir):
    return V.vitals_project(V.event_envelope(V.events(spark, sf_dir)))


@query(
    "filter_event_types",
    S.with_(S.EV)
    + "SELECT event_id, raw_type AS event_type FROM ev WHERE raw_type IN ('signup', 'click', 'error')",
)
def q_filter_event_types(spark, sf_dir):
    return V.events(spark, sf_dir).filter(F.col("event_type").isin("signup", "click", "error")).select("event_id", "event_type")


@query(
    "admissions_fact",
    S.with_(S.EV, S.ADM) + "SELECT patient_id, encounter_id, event_ts, full_name, birth_date, gender FROM adm",
)
def q_admissions_fact(spark, sf_dir):
    return V.admissions(spark, sf_dir)


@query(
    "live_window_status",
    S.with_(S.EV, S.CDC, S.HIST, S.VIT, S.LIVE)
    + """SELECT window_start, window_end, unit, reading_count,
       window_end <= (SELECT max(event_ts) FROM vit WHERE itemid = 'heart_rate') AS is_complete FROM live""",
)
def q_live_window_status(spark, sf_dir):
    """The live rollup with the still-filling window marked, not hidden: the
    newest event time is a scalar subquery that every window is compared with."""
    readings = V.fct_vitals(spark, sf_dir).filter(F.col("itemid") == "heart_rate")
    high = readings.agg(F.max("event_ts").alias("m")).scalar()
    out = live.mark_complete(live_vitals_by_unit(spark, sf_dir), high)
    return out.select("window_start", "window_end", "unit", "reading_count", "is_complete")
