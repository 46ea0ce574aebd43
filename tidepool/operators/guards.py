"""Governance on tables: column masks, row filters, text scans, result guards
and query-log audits. Every scan is a Column expression evaluated inside the
executors over a table of texts; no text is read back to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.contracts import MASK_LITERAL, MASKED_COLUMNS, MIN_CELL_SIZE

# ---------------------------------------------------------------------------
# Injection heuristics, identifier requests, audit patterns.
# ---------------------------------------------------------------------------
OVERRIDE_PHRASES = (
    "ignore previous instructions",
    "ignore all previous",
    "ignore prior instructions",
    "disregard previous instructions",
    "you are now",
    "system:",
    "new instructions:",
)
EXFIL_VERBS = ("reveal", "output the", "print the", "tell me the", "show me the")
SENSITIVE_NOUNS = ("mrn", "full_name", "full name", "ssn", "social security", "name and", "patient's name")
EXFIL_WORD_PATTERN = r"\b(reveal|leak|expose)\b"
VERB_WINDOW = 60
PHI_REQUEST_PATTERN = (
    r"(?i)\b(full[_ ]?names?|mrns?|medical record numbers?|patient'?s? names?"
    r"|names? of (the |every |each |all )?patients?)\b"
)
COUNT_LIKE_PATTERN = r"(?i)(^|_)(count|cnt|num|n|patients|census|total)(_|$)"
TABLE_REF_PATTERN = r"(?i)\b(?:from|join)\s+([`\w.]+)"
EQ_FILTER_PATTERN = r"`?(\w+)`?\s*=\s*'([^']*)'"
COUNT_ALIAS_PATTERN = r"(?i)\bcount\s*\((?:[^()]|\([^()]*\))*\)\s*(?:as\s+)?`?(\w+)`?"
DISALLOWED_SCHEMAS = ("bronze", "silver", "ops", "information_schema", "system")
GOLD_SCHEMA = "main.gold"
PATIENT_TABLES = ("dim_patients", "fct_encounters", "fct_encounter_history", "fct_vitals", "gold_live_vitals_by_unit")
MRN_PATTERN = r"^MRN-\d{6}$"
UNTRUSTED_OPEN, UNTRUSTED_CLOSE = "<untrusted_data>", "</untrusted_data>"
TRUNCATED_SUFFIX = "...<truncated>"

ALL_MASKED = sorted({c for cols in MASKED_COLUMNS.values() for c in cols})


# ---------------------------------------------------------------------------
# Column masks and row filters
# ---------------------------------------------------------------------------
def mask_value(col: Column, groups: Iterable[str]) -> Column:
    """Scalar mask: the value for members of ``phi_unmasked``, else the mask."""
    return col if "phi_unmasked" in set(groups) else F.lit(MASK_LITERAL)


def mask_columns(df: DataFrame, table: str, role: str) -> DataFrame:
    """Masked columns of ``table`` replaced by the mask literal unless the
    role is ``phi_unmasked``; unlisted tables pass through unchanged."""
    masked = set(MASKED_COLUMNS.get(table, ()))
    if role == "phi_unmasked" or not masked:
        return df
    return df.select(*[(F.lit(MASK_LITERAL).alias(c) if c in masked else F.col(c)) for c in df.columns])


def unit_row_filter(unit: Column, groups: Iterable[str]) -> Column:
    """Admin, or member of ``unit_<unit>``, or not a restricted reader."""
    groups = {g.lower() for g in groups}
    if "clinical_admin" in groups or "clinical_reader" not in groups:
        return F.lit(True)
    allowed = [g for g in groups if g.startswith("unit_")]
    return F.concat(F.lit("unit_"), F.lower(unit)).isin(*allowed) if allowed else F.lit(False)


def row_filter(df: DataFrame, unit_col: str, groups: Iterable[str]) -> DataFrame:
    return df.filter(F.coalesce(unit_row_filter(F.col(unit_col), groups), F.lit(False)))


def check_column(table: str, column: str, purpose: str) -> str:
    """Refuse filtering, aggregating or grouping on a masked column."""
    if column in MASKED_COLUMNS.get(table, ()):
        raise ValueError(f"cannot {purpose} on masked column: {column}")
    return column


# ---------------------------------------------------------------------------
# Text scans
# ---------------------------------------------------------------------------
def injection_flag(text: Column, max_chars: int | None = None) -> Column:
    """TRUE when the text holds an override phrase; or an exfiltration verb
    (first occurrence of each) within 60 characters of a sensitive noun; or
    a reveal/leak/expose word plus a sensitive noun anywhere.

    ``max_chars`` scans only the first characters (the reference's input cap);
    the default scans the whole text.
    """
    t = F.lower(text if max_chars is None else F.substring(text, 1, max_chars))

    def any_noun(s: Column) -> Column:
        return F.greatest(*[F.instr(s, n) for n in SENSITIVE_NOUNS]) > 0

    override = F.greatest(*[F.instr(t, p) for p in OVERRIDE_PHRASES]) > 0
    near = F.lit(False)
    for verb in EXFIL_VERBS:
        pos = F.instr(t, verb)  # 1-based; 0 = absent
        start0 = F.greatest(F.lit(0), pos - 1 - VERB_WINDOW)
        end0 = pos - 1 + VERB_WINDOW
        window = F.substring(t, (start0 + 1).cast("int"), (end0 - start0).cast("int"))
        near = near | ((pos > 0) & any_noun(window))
    word = t.rlike(EXFIL_WORD_PATTERN) & any_noun(t)
    return F.coalesce(override | near | word, F.lit(False))


def wrap_untrusted(text: Column, flag: Column) -> Column:
    return F.when(flag, F.concat(F.lit(UNTRUSTED_OPEN), text, F.lit(UNTRUSTED_CLOSE))).otherwise(text)


def truncate_text(text: Column, max_chars: int) -> Column:
    """Cap with a ``...<truncated>`` suffix (the whole text is measured)."""
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(TRUNCATED_SUFFIX))).otherwise(text)


def phi_request(text: Column) -> Column:
    return F.coalesce(text.rlike(PHI_REQUEST_PATTERN), F.lit(False))


def identifier_leak(df: DataFrame) -> Column:
    """Per row: a named identifier column not masked, or an MRN-looking value."""
    checks = []
    for f in df.schema.fields:
        if f.dataType.simpleString() != "string":
            continue
        c = F.col(f"`{f.name}`")
        if f.name.lower() in ("full_name", "mrn"):
            checks.append(c.isNotNull() & (c != MASK_LITERAL))
        checks.append(F.coalesce(c.rlike(MRN_PATTERN), F.lit(False)))
    out = F.lit(False)
    for c in checks:
        out = out | c
    return out


# ---------------------------------------------------------------------------
# Result guard and redaction
# ---------------------------------------------------------------------------
def result_guard(df: DataFrame, suppress_small_counts: bool = True, count_columns: Sequence[str] = ()) -> DataFrame:
    """Mask identifier columns by name (any case); NULL small integers
    (1..10) in count-like columns and add ``<col>_suppressed``."""
    import re

    count_like = re.compile(COUNT_LIKE_PATTERN[4:], re.IGNORECASE)
    wanted = {c.lower() for c in count_columns}
    out = []
    for f in df.schema.fields:
        name = f.name.lower()
        c = F.col(f"`{f.name}`")
        if name in ALL_MASKED:
            out.append(F.lit(MASK_LITERAL).alias(f.name))
        elif (
            suppress_small_counts
            and (name in wanted or count_like.search(name))
            and f.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint")
        ):
            small = (c > 0) & (c < MIN_CELL_SIZE)
            out += [F.when(small, F.lit(None)).otherwise(c).alias(f.name), F.coalesce(small, F.lit(False)).alias(f"{f.name}_suppressed")]
        else:
            out.append(c)
    return df.select(*out)


def guard_report(df: DataFrame, suppress_small_counts: bool = True, count_columns: Sequence[str] = ()) -> DataFrame:
    """What ``result_guard`` does to a result, as one row: row_count, the masked
    columns (sorted names), masked_cells (that held something), raw_values
    (different ones among them) and suppressed_cells."""
    masked = sorted(f.name for f in df.schema.fields if f.name.lower() in ALL_MASKED)
    guarded = result_guard(df, suppress_small_counts, count_columns)
    flags = [c for c in guarded.columns if c.endswith("_suppressed") and c not in df.columns]
    cells = [F.count(F.col(f"`{c}`")) for c in masked]
    suppressed = guarded.select(*[F.col(f"`{c}`").cast("int").alias(f"s{i}") for i, c in enumerate(flags)])
    zero = F.lit(0).cast("long")
    hidden = suppressed.agg(sum((F.coalesce(F.sum(f"s{i}"), zero) for i in range(len(flags))), zero).alias("n")).scalar() if flags else zero
    values = [F.when(F.col(f"`{c}`") != MASK_LITERAL, F.col(f"`{c}`").cast("string")) for c in masked]
    raw = df.select(F.explode(F.array(*values)).alias("v")).agg(F.count_distinct("v")).scalar() if masked else zero
    return df.agg(F.count(F.lit(1)).alias("row_count"), sum(cells, zero).alias("masked_cells")).select(
        "row_count", F.lit(",".join(masked)).alias("masked_columns"), "masked_cells", F.coalesce(raw, zero).alias("raw_values"), hidden.alias("suppressed_cells")
    )


WITHHELD = f"The answer was withheld: it includes a group of fewer than {MIN_CELL_SIZE} patients, which is too small to report."


def withhold(texts: DataFrame, guarded: DataFrame, key: str, text_col: str) -> DataFrame:
    """``texts`` with ``withheld``: a text is replaced where a cell of the rows
    of its key was suppressed (``guarded``: from ``result_guard``)."""
    flags = [F.col(f"`{c}`") for c in guarded.columns if c.endswith("_suppressed")]
    hit = F.greatest(F.lit(False), F.lit(False), *flags) if flags else F.lit(False)
    per = guarded.groupBy(F.col(key).alias("__key")).agg(F.bool_or(hit).alias("withheld"))
    met = texts.join(per, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    return met.withColumn("withheld", F.coalesce("withheld", F.lit(False))).withColumn(text_col, F.when(F.col("withheld"), F.lit(WITHHELD)).otherwise(F.col(text_col)))


#: A value is looked for where its first characters stand.
HEAD = 3


def redact_values(texts: DataFrame, values: DataFrame, key: str, text_col: str, value_col: str) -> DataFrame:
    """Replace every raw value of the same ``key`` found inside the text by the
    mask literal, in the values' order; ``leaked_values`` says how many were found.

    A value can only stand where its first three characters do, so texts and
    values meet on (key, those characters) and what meets is compared. A row
    gathers the values its own text holds, never all those of its key."""
    named = values.select(F.col(key).alias("k"), F.col(value_col).cast("string").alias("v")).where("v <> ''").distinct()
    named = named.withColumn("head", F.left("v", F.lit(HEAD)))
    own = texts.select(F.col(key).alias("k"), F.col(text_col).alias("t")).where("t is not null").distinct()
    places = F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)))
    heads = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(F.col("t"), i, F.lit(n)) for n in range(1, HEAD + 1)]))))
    met = own.withColumn("head", F.explode(heads)).join(named, ["k", "head"]).where(F.contains("t", "v"))
    found = met.groupBy("k", "t").agg(F.array_sort(F.collect_set("v")).alias("__vals")).withColumnsRenamed({"k": "__k", "t": "__t"})
    joined = texts.join(found, (F.col(key) == F.col("__k")) & (F.col(text_col) == F.col("__t")), "left")
    vals = F.coalesce(F.col("__vals"), F.array().cast("array<string>"))
    redacted = F.aggregate(vals, F.col(text_col), lambda acc, v: F.replace(acc, v, F.lit(MASK_LITERAL)))
    return joined.withColumn("leaked_values", F.size(vals)).withColumn(text_col, redacted).drop("__vals", "__k", "__t")


# ---------------------------------------------------------------------------
# Query-log audit
# ---------------------------------------------------------------------------
def table_refs(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(TABLE_REF_PATTERN), 1)


def outside_gold(sql: Column) -> Column:
    """Table references outside the allowed schema."""
    def bad(ref):
        parts = F.split(F.lower(F.regexp_replace(ref, "`", "")), r"\.")
        n = F.size(parts)
        schemas = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
        disallowed = F.exists(schemas, lambda p: p.isin(*DISALLOWED_SCHEMAS))
        foreign = (n == 3) & (F.array_join(F.slice(parts, 1, 2), ".") != GOLD_SCHEMA)
        return disallowed | foreign

    return F.filter(table_refs(sql), bad)


def reads_patient_data(sql: Column) -> Column:
    refs = F.transform(table_refs(sql), lambda r: F.element_at(F.split(F.lower(F.regexp_replace(r, "`", "")), r"\."), -1))
    return F.when(sql.isNull(), True).otherwise((F.size(refs) == 0) | F.exists(refs, lambda r: r.isin(*PATIENT_TABLES)))


def count_aliases(sql: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(COUNT_ALIAS_PATTERN), 1), F.lower))


def unasked_filters(question: Column, sql: Column, dimensions: Mapping[str, Mapping]) -> Column:
    """Equality filters on closed-list dimensions whose value (or a synonym of
    it) the question never names as a whole word: ``"col = 'value'"`` list."""
    pairs = F.regexp_extract_all(sql, F.lit(EQ_FILTER_PATTERN), 0)
    q = F.lower(question)

    def words_hit(col_name, value):
        hit = F.lit(False)
        for dim, spec in dimensions.items():
            if not spec.get("values"):
                continue
            is_dim = F.lower(col_name) == dim
            syn_alts = [s for s, tgt in spec.get("synonyms", {}).items()]
            # the value itself, as a whole word
            escaped = F.regexp_replace(F.lower(value), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
            direct = F.coalesce(F.regexp_like(q, F.concat(F.lit(r"\b"), escaped, F.lit(r"\b"))), F.lit(False))
            syn = F.lit(False)
            for s in syn_alts:
                tgt = spec["synonyms"][s]
                syn = syn | ((value == F.lit(tgt)) & q.rlike(r"\b" + _re_escape(s.lower()) + r"\b"))
            hit = hit | (is_dim & (direct | syn))
        return hit

    def is_closed_dim(col_name):
        dims = [d for d, spec in dimensions.items() if spec.get("values")]
        return F.lower(col_name).isin(*dims)

    def parse(p):
        col_name = F.regexp_extract(p, EQ_FILTER_PATTERN, 1)
        value = F.regexp_extract(p, EQ_FILTER_PATTERN, 2)
        return F.struct(col_name.alias("c"), value.alias("v"))

    parsed = F.transform(pairs, parse)
    flagged = F.filter(parsed, lambda s: is_closed_dim(s["c"]) & ~words_hit(s["c"], s["v"]))
    return F.transform(flagged, lambda s: F.concat(s["c"], F.lit(" = '"), s["v"], F.lit("'")))


def _re_escape(s: str) -> str:
    import re

    return re.escape(s)
