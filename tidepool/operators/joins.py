"""Join operators.

Broadcast policy: a side is hinted for broadcast only when its size is fixed
by construction (a literal lookup such as the nickname list or the limits
relation, see ``literal_lookup``). Sides derived from data are never hinted;
AQE measures them at runtime and switches to a broadcast hash join only when
the shuffled size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators.sequence import carry_forward

# Literal lookups above this many rows are not broadcast by hint.
MAX_LITERAL_BROADCAST_ROWS = 10_000


def literal_lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small relation from Python literals, broadcast-hinted when its row
    count (known here, not estimated) is within the bound."""
    df = spark.createDataFrame(list(rows), schema)
    return F.broadcast(df) if len(rows) <= MAX_LITERAL_BROADCAST_ROWS else df


def asof_interval_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    left_ts: str,
    right_key: str,
    valid_from: str,
    valid_to: str,
    attrs: Sequence[str],
    segment: str | None = "day",
) -> DataFrame:
    """Left join each left row to the right version with the same key and
    ``valid_from <= ts < valid_to`` (``valid_to`` NULL = open). Unmatched left
    rows get NULL ``attrs``.

    Precondition: per key the right intervals do not overlap (an SCD2
    history). Then at most one version matches, and it is the latest version
    starting at or before ``ts``. Instead of an equi-join on the key with a
    range residual (every reading of a key against every version of that key:
    quadratic for a hot key), both sides are merged into one ordered stream
    and the latest version is carried forward to each reading. With
    ``segment`` (a ``date_trunc`` unit) the carry-forward runs per
    (key, time segment), so a hot key is still split across tasks.
    """
    attrs = list(attrs)
    left_cols = left.columns
    version = F.struct(
        F.col(valid_from).alias("f"), F.col(valid_to).alias("t"), *[F.col(a).alias(a) for a in attrs]
    )
    r = right.select(
        F.col(right_key).alias("__k"),
        F.col(valid_from).alias("__t"),
        F.lit(0).alias("__side"),
        # versions starting at the same instant: the zero-length one first
        F.when(F.col(valid_to) == F.col(valid_from), 0).otherwise(1).alias("__zero"),
        version.alias("__v"),
    )
    l = left.select(
        *[F.col(c) for c in left_cols],
        F.col(left_key).alias("__k"),
        F.col(left_ts).alias("__t"),
        F.lit(1).alias("__side"),
        F.lit(1).alias("__zero"),
        F.lit(None).cast(r.schema["__v"].dataType).alias("__v"),
    )
    stream = l.unionByName(r, allowMissingColumns=True).withColumn("__is_left", F.col("__side") == 1)
    order = ["__t", "__side", "__zero"]
    seg = None
    if segment is not None:
        seg = "__segment"
        stream = stream.withColumn(seg, F.date_trunc(segment, F.col("__t")))
    filled = carry_forward(stream, ["__k"], order, ["__v"], segment=seg)
    hit = F.col("__v").isNotNull() & (F.col("__v.t").isNull() | (F.col("__t") < F.col("__v.t")))
    return filled.filter("__is_left").select(
        *[F.col(c) for c in left_cols],
        *[F.when(hit, F.col(f"__v.{a}")).alias(a) for a in attrs],
    )


def blocked_self_join(
    df: DataFrame, block: str, id_col: str, columns: Sequence[str], residual: Column | None = None
) -> DataFrame:
    """Pairs ``a.id < b.id`` inside the same ``block`` (an equi-join on the
    block, so only rows sharing a block are compared), with an optional
    residual over ``a.*``/``b.*``. Output columns are ``<col>_a``, ``<col>_b``.

    Neither side is broadcast: both are as large as the data, whatever plan
    statistics make of rows that a generator made.
    Pair count per block is quadratic in the block size by nature of the
    check; blocks must be selective keys (birth date, gender, name parts).
    """
    cols = [id_col, *[c for c in columns if c != id_col]]
    a = df.select(F.col(block).alias("__block"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(F.col(block).alias("__block"), *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = a.join(b.hint("merge"), "__block").filter(F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))
    if residual is not None:
        pairs = pairs.filter(residual)
    return pairs.drop("__block")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return left.join(right, on=on, how="left_anti")


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return left.join(right, on=on, how="left_semi")
