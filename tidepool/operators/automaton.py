"""A state machine run over the events of every key, without a window per key.

An event maps each state to a state (and may be illegal in it). The events of a
(key, segment) compose to one such map, found without knowing the state in
which the segment begins; the maps of a key's segments, one short array each,
compose in order and give every segment its first state; then each segment is
run by itself. So a key with a third of all events is spread over its segments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Automaton:
    """States (the first is the start), and for (state, event) the next state
    and, if illegal, the problem's name. Pairs that are not listed change
    nothing and are no problem."""

    states: Sequence[str]
    events: Sequence[str]
    moves: Mapping[tuple[str, str], tuple[str, str | None]]

    def _table(self, pick) -> Column:
        return F.array(*[F.lit(pick(s, e)) for s in self.states for e in self.events])

    def next_state(self, state: Column, event: Column) -> Column:
        """Numbers in, number out (from 0)."""
        table = self._table(lambda s, e: list(self.states).index(self.moves.get((s, e), (s, None))[0]))
        return F.get(table, state * len(self.events) + event)

    def problem(self, state: Column, event: Column) -> Column:
        table = F.array(*[F.lit(self.moves.get((s, e), (s, None))[1]).cast("string") for s in self.states for e in self.events])
        return F.get(table, state * len(self.events) + event)

    def number(self, event: Column) -> Column:
        """The event's number, null for one the automaton does not know."""
        at = F.array_position(F.array(*map(F.lit, self.events)), event)
        return F.when(at > 0, (at - 1).cast("int"))

    def name(self, state: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.states)), state)


def _segments(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], event: str, machine: Automaton) -> DataFrame:
    """keys, segment and its events in order: (order columns..., code)."""
    code = machine.number(F.col(event))
    entry = F.struct(*order, code.alias("code"))
    return df.where(code.isNotNull()).groupBy(*keys, segment).agg(F.sort_array(F.collect_list(entry)).alias("run"))


def segment_maps(runs: DataFrame, machine: Automaton) -> DataFrame:
    """Adds ``map``: for each state before the segment the one after it."""
    start = F.array(*[F.lit(i) for i in range(len(machine.states))])
    composed = F.aggregate("run", start, lambda m, e: F.transform(m, lambda s: machine.next_state(s, e["code"])))
    return runs.withColumn("map", composed)


def run(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], event: str, machine: Automaton) -> DataFrame:
    """keys, segment, entry (state before), exit (state after) and problems: an
    array of (order columns..., state, problem), in order.

    ``segment`` must not decrease along ``order``; its width bounds what one
    task holds at a time. Events the automaton does not know are left out."""
    runs = segment_maps(_segments(df, keys, segment, order, event, machine), machine)
    # A key's maps: one short array a segment.
    maps = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(segment).alias("s"), F.col("map").alias("m")))).alias("maps"))
    first = F.struct(F.lit(0).alias("state"), F.expr("cast(array() as array<int>)").alias("entries"))
    entries = F.aggregate(
        "maps",
        first,
        lambda acc, x: F.struct(F.get(x["m"], acc["state"]).alias("state"), F.concat(acc["entries"], F.array(acc["state"])).alias("entries")),
        lambda acc: acc["entries"],
    )
    begin = maps.select(*keys, F.explode(F.arrays_zip(F.col("maps.s").alias("s"), entries.alias("e"))).alias("x"))
    begin = begin.select(*keys, F.col("x.s").alias(segment), F.col("x.e").alias("entry"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, segment]]
    met = runs.alias("r").join(begin.alias("b"), on).select(*[F.col(f"r.{c}") for c in [*keys, segment]], "run", "map", "entry")
    # The state before each event, by running the segment from its entry.
    states = F.aggregate(
        "run",
        F.struct(F.col("entry").alias("state"), F.expr("cast(array() as array<int>)").alias("before")),
        lambda acc, e: F.struct(machine.next_state(acc["state"], e["code"]).alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before")),
        lambda acc: acc["before"],
    )
    judged = F.zip_with("run", states, lambda e, s: F.struct(*[e[c].alias(c) for c in order], machine.name(s).alias("state"), machine.problem(s, e["code"]).alias("problem")))
    problems = F.filter(judged, lambda x: x["problem"].isNotNull())
    return met.select(*keys, segment, machine.name(F.col("entry")).alias("entry"), machine.name(F.get("map", F.col("entry"))).alias("exit"), problems.alias("problems"))


def illegal_moves(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], event: str, machine: Automaton) -> DataFrame:
    """keys, order columns, state and problem of every illegal event."""
    found = run(df, keys, segment, order, event, machine)
    return found.select(*keys, F.explode("problems").alias("p")).select(*keys, "p.*")


def open_since(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str], event: str, machine: Automaton, state: str) -> DataFrame:
    """Keys whose last state is ``state``, and the first order column of the
    event that led there (the last one that changed the state to it)."""
    runs = run(df, keys, segment, order, event, machine)
    last = runs.groupBy(*keys).agg(F.max_by("exit", segment).alias("state"))
    # An entry event is one that leads to the state from another one.
    at = list(machine.states).index(state)
    coded = _segments(df, keys, segment, order, event, machine).alias("r")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*keys, segment]]
    met = coded.join(runs.select(*keys, segment, "entry").alias("e"), on).select(*[F.col(f"r.{c}") for c in keys], "run", "entry")
    entry = F.array_position(F.array(*map(F.lit, machine.states)), F.col("entry")).cast("int") - 1
    entered = F.aggregate(
        "run",
        F.struct(entry.alias("state"), F.lit(None).cast(df.schema[order[0]].dataType).alias("since")),
        lambda acc, e: F.struct(
            machine.next_state(acc["state"], e["code"]).alias("state"),
            F.when((acc["state"] != at) & (machine.next_state(acc["state"], e["code"]) == at), e[order[0]]).otherwise(acc["since"]).alias("since"),
        ),
        lambda acc: acc["since"],
    )
    since = met.select(*keys, entered.alias("since")).groupBy(*keys).agg(F.max("since").alias("since"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]
    return last.where(F.col("state") == state).alias("l").join(since.alias("s"), on).select(*[F.col(f"l.{c}") for c in keys], "state", "since")
