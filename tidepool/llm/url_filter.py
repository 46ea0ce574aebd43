"""URL rules by a cascade of Bloom filters.

A rule names a host and the start of a path; it fits the host, its subdomains
and every path that starts so, and the longest fitting rule judges the URL. The
keys a URL could match are therefore few: for each shape that occurs among the
rules (host labels, path length) the last labels of its host and that much of
its path. All keys of all URLs are the universe.

For the rules of each verdict a cascade tells which keys of the universe are
listed. Level 0 holds the listed keys; level 1 those other keys of the universe
that level 0 passes by mistake; level 2 the listed keys that level 1 passes, and
so on until no mistake is left. A key is then followed until a level does not
know it: an even level says "not listed", an odd one "listed"; a key that all
levels know belongs to what the last level holds. As every key was in the
universe, the answers are exact and no row meets the list in a join; each level
hashes the key anew, so keys that one level cannot tell apart part at the next.

The first level's rate follows from the numbers of listed and other keys, the
later ones are one half, so a cascade takes some bits for each listed key and
grows with the list, not with the corpus. A cascade that would take more than
``max_bytes`` is dealt into shards by key, each built and broadcast on its own,
in as many passes over the URLs (written in between). Levels are made by grouped
bitmaps; the driver sees their bits alone.

Null and odd rows: a null URL, and one without ``://``, has an empty host and
path. Rows are judged one by one, so repeated rows and page_ids stay as they
are. Of two fitting rules of one length the one with the longer host wins; a key
listed with both verdicts blocks. A rule without host or with a verdict other
than allow or block fits nothing, a null path counts as empty. A URL no rule
fits gets ``default``. An empty table gives an empty result, an empty list gives
every URL the default. Further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage

#: Bytes of the filters that one pass broadcasts.
MAX_BYTES = 64 << 20
#: Bits of a row of ``bitmap_construct_agg``.
_ROW_BITS = 32_768
#: Mistakes halve from level to level; so many levels mean that something is wrong.
_MOST_LEVELS = 80

ALLOW, BLOCK = "allow", "block"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_letters(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, _CAPITALS, _SMALL)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end (A-Z
    lower-cased), and from there up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return small_letters(host), F.regexp_extract(after, r"^[^?#]*", 0)


def labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.translate(host, ".", "")) + 1


def candidate(host: Column, path: Column, n_labels: int, path_length: int) -> Column:
    """The key of one shape, null where the URL is too short for it."""
    long_enough = (labels(host) >= n_labels) & (F.char_length(path) >= path_length)
    return F.when(long_enough, F.concat(F.substring_index(host, ".", -n_labels), F.substring(path, 1, path_length)))


def level_hash(key: Column, level: int) -> Column:
    return F.xxhash64(F.lit(level), key)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))


@dataclass
class Level:
    bits: int
    hashes: int

    @classmethod
    def sized(cls, keys: int, rate: float) -> Level:
        """For so many keys and such a rate of mistakes."""
        per_key = max(1.0, -math.log2(rate))
        bits = max(64, math.ceil(keys * per_key / math.log(2)))
        return cls(-(-bits // 8) * 8, max(1, round(per_key)))

    def places(self, h: Column) -> Column:
        """The bits of a key, by double hashing of its 64-bit hash."""
        low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(1)
        return F.array(*[F.pmod(low + high * i, F.lit(self.bits)) for i in range(self.hashes)])

    def known(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which of the 64-bit hashes have all their bits in the table."""
        h = h.view(np.uint64)
        low, high = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) | 1
        out = np.ones(len(h), bool)
        for i in range(self.hashes):
            at = (low + high * i) % self.bits
            out &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _table(keys: DataFrame, level: Level, k: int) -> np.ndarray:
    """The level's bits: grouped bitmaps, of which the driver joins the rows."""
    place = keys.select(F.explode(level.places(level_hash(F.col("key"), k))).alias("place"))
    rows = place.groupBy(F.floor(F.col("place") / _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("place") % _ROW_BITS).alias("bits"))
    table = np.zeros(-(-level.bits // _ROW_BITS) * (_ROW_BITS // 8), np.uint8)
    for row, bits in rows.collect():
        table[row * (_ROW_BITS // 8) : (row + 1) * (_ROW_BITS // 8)] = np.frombuffer(bits, np.uint8)
    return table[: level.bits // 8]


@dataclass
class Cascade:
    """Levels with their broadcast bits; holds for the keys it was built from."""

    levels: list[Level] = field(default_factory=list)
    tables: list[Broadcast] = field(default_factory=list)

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """``hashes``: a row for each key, a column for each level."""
        out = np.full(len(hashes), len(self.levels) % 2 == 1)
        open_ = np.arange(len(hashes))
        for k, (level, table) in enumerate(zip(self.levels, self.tables)):
            known = level.known(table.value, np.ascontiguousarray(hashes[open_, k]))
            out[open_[~known]] = k % 2 == 1
            open_ = open_[known]
        return out

    @property
    def bytes(self) -> int:
        return sum(level.bits // 8 for level in self.levels)


def first_rate(listed: int, others: int) -> float:
    """So low that level 1 holds about as many keys as level 0 does."""
    return min(0.5, math.sqrt(0.5) * listed / max(others, 1))


def expected_bytes(listed: int, others: int) -> float:
    """Of a whole cascade: level 0, and later levels of a bit and a half a key, which halve."""
    return listed * (1 - math.log2(first_rate(listed, others)) + 6) / math.log(2) / 8


def build(keys: DataFrame, listed: int, others: int) -> Cascade:
    """A cascade over ``keys`` (key, listed), the complete universe, each key once."""
    spark, cascade = keys.sparkSession, Cascade()
    sides = [keys.where("listed").select("key"), keys.where("NOT listed").select("key")]
    sizes = [listed, others]
    while sizes[len(cascade.levels) % 2]:
        k = len(cascade.levels)
        if k == _MOST_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = Level.sized(sizes[k % 2], first_rate(listed, others) if k == 0 else 0.5)
        table = spark.sparkContext.broadcast(_table(sides[k % 2], level, k))
        cascade.levels.append(level)
        cascade.tables.append(table)
        if not sizes[1 - k % 2]:
            break
        known = F.pandas_udf(lambda h, level=level, table=table: pd.Series(level.known(table.value, h.to_numpy(np.int64))), "boolean")
        passed = sides[1 - k % 2].where(known(level_hash(F.col("key"), k)))
        sides[1 - k % 2] = cut_lineage(passed)
        sizes[1 - k % 2] = sides[1 - k % 2].count()
    return cascade


def _codes(found: dict[int, Cascade], n_keys: int, n_levels: int):
    """A UDF: hashes of a row's keys, level by level, to a verdict for each key."""

    def codes(hashes: pd.Series) -> pd.Series:
        if not len(hashes):
            return pd.Series([], dtype=object)
        h = np.stack(hashes.to_numpy()).reshape(-1, n_levels).astype(np.int64)
        out = np.zeros(len(h), np.int32)
        for code, cascade in sorted(found.items()):
            out[cascade.listed(h)] = code
        return pd.Series(list(out.reshape(-1, n_keys)))

    return F.pandas_udf(codes, "array<int>")


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule (the key of the longest
    fitting rule, or null) and verdict. ``rules``: host, path, verdict."""
    rules = rules.select(small_letters(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.where((F.col("host") != "") & F.col("verdict").isin(ALLOW, BLOCK))
    shape = [labels(F.col("host")).alias("labels"), F.char_length("path").alias("length")]
    shapes = [tuple(r) for r in rules.select(*shape).distinct().orderBy("labels", "length").collect()]
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path}).drop("url")
    if not shapes:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = [candidate(F.col("host"), F.col("path"), *s) for s in shapes]
    # Universe and list in one grouping: 1 allow, 2 block.
    seen = rows.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), F.lit(0).alias("code"))
    named = rules.select(F.concat("host", "path").alias("key"), F.when(F.col("verdict") == BLOCK, 2).otherwise(1).alias("code"))
    universe = cut_lineage(seen.union(named).groupBy("key").agg(F.max("code").alias("code")))
    sizes = {r["code"]: r["count"] for r in universe.groupBy("code").count().collect()}
    total = sum(sizes.values())
    wanted = [c for c in (1, 2) if sizes.get(c)]
    need = sum(expected_bytes(sizes[c], total - sizes[c]) for c in wanted)
    shards = max(1, math.ceil(need / max_bytes))
    rows = rows.withColumn("codes", F.array_repeat(F.lit(0), len(shapes)))
    for s in range(shards):
        own = universe if shards == 1 else universe.where(shard_of(F.col("key"), shards) == s)
        held = {r["code"]: r["count"] for r in own.groupBy("code").count().collect()} if shards > 1 else sizes
        n = sum(held.values())
        found = {c: build(own.select("key", (F.col("code") == c).alias("listed")), held[c], n - held[c]) for c in wanted if held.get(c)}
        if not found:
            continue
        n_levels = max(len(c.levels) for c in found.values())
        hashes = F.array(*[F.coalesce(level_hash(key, k), F.lit(0)) for key in keys for k in range(n_levels)])
        answer = _codes(found, len(keys), n_levels)(hashes)
        mine = F.array(*[F.coalesce(key.isNotNull() & (shard_of(key, shards) == s), F.lit(False)) for key in keys])
        rows = rows.withColumn("answer", answer).withColumn("mine", mine)
        rows = rows.withColumn("codes", F.expr("transform(codes, (c, i) -> if(mine[i], answer[i], c))")).drop("answer", "mine")
        if shards > 1:
            rows = cut_lineage(rows)  # the next pass needs these filters no more
    fits = [
        F.when(F.col("codes")[i] > 0, F.struct(F.char_length(key).alias("long"), F.lit(-length).alias("host"), key.alias("rule"), F.col("codes")[i].alias("code")))
        for i, (key, (_, length)) in enumerate(zip(keys, shapes))
    ]
    rows = rows.withColumn("best", F.array_max(F.array(*fits)))
    verdict = F.when(F.col("best.code") == 2, BLOCK).when(F.col("best.code") == 1, ALLOW).otherwise(default)
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def judge_sql(rules: list[tuple[str, str, str]], default: str = ALLOW) -> str:
    """The same in DuckDB SQL, by comparing every rule."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT row_number() OVER () AS row_id, page_id, translate(raw, '{_CAPITALS}', '{_SMALL}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h),
m AS (
  SELECT row_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM p LEFT JOIN m USING (row_id)"""
