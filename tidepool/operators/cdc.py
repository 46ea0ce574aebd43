"""Change capture into current-state (SCD1) and versioned history (SCD2).

All operators take the change feed as a DataFrame, the key columns, the
sequence column and a tie-break column, and are order-insensitive: the same
feed in any row order gives the same result (the order is (sequence, tie)).

SCD1 is an aggregate (``max_by`` per column), so Spark combines partially on
the map side and a hot key never lands whole in one task. SCD2 needs ordered
carry-forward; it uses the segmented helpers of ``sequence`` so one huge key
is still spread over its time segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.sequence import carried_with_next, carry_forward, next_value


def _rank(sequence_by: str, tiebreak: str | None) -> Column:
    return F.struct(F.col(sequence_by), F.col(tiebreak)) if tiebreak else F.struct(F.col(sequence_by))


def scd1_partial(
    changes: DataFrame,
    keys: Sequence[str],
    sequence_by: str,
    columns: Sequence[str],
    tiebreak: str | None = None,
) -> DataFrame:
    """Current state with ``ignore_null_updates``: each column keeps the last
    non-NULL value seen for the key; ``sequence_by`` is the last change's."""
    rank = _rank(sequence_by, tiebreak)
    return changes.groupBy(*keys).agg(
        F.max(sequence_by).alias(sequence_by),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns],
    )


def scd1_latest(
    changes: DataFrame,
    keys: Sequence[str],
    sequence_by: str,
    columns: Sequence[str],
    tiebreak: str | None = None,
) -> DataFrame:
    """Current state, whole-row: the latest change per key wins, NULLs included."""
    rank = _rank(sequence_by, tiebreak)
    row = F.struct(*[F.col(c) for c in [sequence_by, *columns]])
    return changes.groupBy(*keys).agg(F.max_by(row, rank).alias("__row")).select(*keys, "__row.*")


def scd2_history(
    changes: DataFrame,
    keys: Sequence[str],
    sequence_by: str,
    columns: Sequence[str],
    tiebreak: str | None = None,
    start_col: str = "__START_AT",
    end_col: str = "__END_AT",
    segment: str | None = "day",
) -> DataFrame:
    """One version per change; values carried forward through NULLs;
    ``[start, end)`` with ``end`` = the next change's sequence, NULL = current.

    ``segment`` is a ``date_trunc`` unit for the sequence (a time column) that
    splits a key's changes for parallel work; ``None`` uses one window per key.
    """
    keys, columns = list(keys), list(columns)
    order = [sequence_by, tiebreak] if tiebreak else [sequence_by]
    df = changes.select(*{c: None for c in [*keys, *order, *columns]})
    if segment is not None:
        seg = "__segment"
        df = df.withColumn(seg, F.date_trunc(segment, F.col(sequence_by)))
        versioned = carried_with_next(df, keys, order, columns, sequence_by, end_col, seg)
    else:
        versioned = next_value(carry_forward(df, keys, order, columns), keys, order, sequence_by, end_col)
    out = [*keys, *[c for c in columns if c not in keys], F.col(sequence_by).alias(start_col), end_col]
    if tiebreak and tiebreak not in columns and tiebreak not in keys:
        out.append(tiebreak)
    return versioned.select(*out)


def as_of_predicate(ts: Column | str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> Column:
    """Half-open validity: ``valid_from <= t AND (valid_to IS NULL OR valid_to > t)``."""
    t = F.lit(ts).cast("timestamp_ntz") if isinstance(ts, str) else ts
    return (F.col(valid_from) <= t) & (F.col(valid_to).isNull() | (F.col(valid_to) > t))


def as_of(history: DataFrame, ts: Column | str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Point-in-time snapshot of a history table."""
    return history.filter(as_of_predicate(ts, valid_from, valid_to))
