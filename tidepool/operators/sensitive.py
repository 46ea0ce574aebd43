"""Sensitive values in columns that were not declared to hold any.

The schema is walked: every string, however deep in structs, arrays and maps,
is a path. One aggregate over the table counts for each path and pattern the
rows that hold a match, so a table is read once whatever its shape; what a
registry declares is set beside it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns that read the same in Java's and other common regular expressions.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "ip_address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "record_number": r"\bMRN-[0-9]+\b",
}


def string_paths(kind: T.DataType, path: str, column: Column, many: bool = False) -> Iterator[tuple[str, Column, bool]]:
    """(path, column, whether it is an array of strings) of every string in a
    column of this type (``many``: of an array of it); ``[]`` stands for the
    elements of an array, ``keys`` and ``values`` for those of a map."""

    def each(of) -> Column:
        return F.transform(column, of) if many else of(column)

    def field(name: str):
        return lambda x: x.getField(name)

    def flat(arrays: Column) -> Column:
        return F.flatten(F.filter(arrays, lambda x: x.isNotNull())) if many else arrays

    if isinstance(kind, T.StringType):
        yield path, column, many
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from string_paths(f.dataType, f"{path}.{f.name}", each(field(f.name)), many)
    elif isinstance(kind, T.ArrayType):
        yield from string_paths(kind.elementType, f"{path}[]", flat(column), True)
    elif isinstance(kind, T.MapType):
        yield from string_paths(kind.keyType, f"{path}.keys", flat(each(F.map_keys)), True)
        yield from string_paths(kind.valueType, f"{path}.values", flat(each(F.map_values)), True)


def _holds(column: Column, many: bool, pattern: str) -> Column:
    hit = (lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))
    return F.coalesce(F.exists(column, hit), F.lit(False)) if many else hit(column)


def sensitive_profile(df: DataFrame, patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """path, pattern, rows, hits for every string of the schema that holds a
    match of a pattern in some row; names of columns play no part."""
    found = [p for f in df.schema.fields for p in string_paths(f.dataType, f.name, F.col(f"`{f.name}`"))]
    if not found:
        return df.sparkSession.createDataFrame([], "path string, pattern string, rows long, hits long")
    cells = [(path, name, _holds(column, many, regex)) for path, column, many in found for name, regex in patterns.items()]
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), F.array(*[F.count_if(c) for *_, c in cells]).alias("hits")
    )
    labels = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(n).alias("pattern")) for p, n, _ in cells])
    out = counted.select("rows", F.explode(F.arrays_zip(labels.alias("at"), F.col("hits"))).alias("x"))
    return out.select("x.at.path", "x.at.pattern", "rows", F.col("x.hits").alias("hits")).where("hits > 0")


def undeclared(df: DataFrame, table: str, registry: Mapping[str, Sequence[str]], patterns: Mapping[str, str] = PATTERNS) -> DataFrame:
    """The profile with ``table`` and ``declared``: whether the registry (pattern
    names by ``table.path``) expects the pattern there."""
    declared = F.array(*[F.lit(f"{path}|{name}") for path, names in registry.items() for name in names]).cast("array<string>")
    key = F.concat(F.lit(f"{table}."), "path", F.lit("|"), "pattern")
    return sensitive_profile(df, patterns).select(
        F.lit(table).alias("table_name"), "path", "pattern", "rows", "hits", F.array_contains(declared, key).alias("declared")
    )
