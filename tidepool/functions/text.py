"""Text column builders: tokens, query terms, page focus, word n-grams.

Pure Column expressions (no jobs); operators in ``operators/search.py``
turn them into scans and joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Tokenizer stop words, stem suffixes, query synonyms.
# ---------------------------------------------------------------------------
STOPWORDS = (
    "the", "and", "for", "but", "not", "are", "was", "were", "with", "from", "that", "this", "has", "have",
    "into", "its", "our", "out", "all", "any", "can", "why", "how", "what", "when", "who", "does", "did",
    "get", "got", "one", "too", "very", "just", "still", "than", "then", "there", "they", "them", "been",
    "being", "will", "would", "should", "could", "about", "after", "before", "while", "every", "each",
)
STEM_SUFFIXES = ("ing", "ed", "es", "s")
SYNONYMS = {
    "lag": ["backlog", "behind"],
    "lagging": ["backlog", "behind"],
    "slow": ["behind", "duration"],
    "down": ["outage", "fails", "unavailable"],
    "outage": ["down", "unavailable"],
    "crash": ["fails", "failed"],
    "crashed": ["fails", "failed"],
    "zero": ["0", "sentinel"],
    "0": ["sentinel", "zero"],
    "silent": ["silence", "stops", "sending"],
    "quiet": ["silence", "stops", "sending"],
    "green": ["healthy", "silence"],
    "nothing": ["silence", "stops"],
    "flood": ["spike", "floods", "volume"],
    "overload": ["spike", "volume", "backlog"],
    "spike": ["volume", "10x"],
    "timezone": ["time", "zone", "offset"],
    "clock": ["skew", "time"],
    "1970": ["clock", "skew", "reset"],
    "fahrenheit": ["unit", "temp", "celsius"],
    "duplicate": ["duplicates", "dedup", "replay"],
    "duplicates": ["dedup", "replay"],
    "transfer": ["transfers", "unit", "transferred"],
    "transferred": ["transfer", "unit"],
    "wrong": ["mismatch", "misattribute"],
    "phi": ["masked", "mask", "pii"],
    "name": ["masked", "phi"],
    "count": ["counts", "aggregates", "counting"],
    "500": ["cap", "capped", "rows"],
    "deploy": ["deployment", "release"],
    "deployed": ["deployment", "deploy"],
    "rollback": ["previous", "version", "deploy"],
    "permission": ["permission_denied", "grant", "access"],
    "denied": ["permission", "grant"],
    "403": ["permission", "access"],
    "oom": ["memory", "infrastructure"],
    "memory": ["oom"],
    "quota": ["capacity", "gcp"],
    "cost": ["dbu", "budget", "spend"],
    "stale": ["freshness", "fresh", "old"],
    "late": ["watermark", "delay", "late"],
    "unknown": ["contract", "hard-stop", "unrecognized"],
}
WORD_PATTERN = "[a-z0-9_]+"


def stem(t: Column) -> Column:
    """Drop the first matching suffix (in order) when the word is more than
    three characters longer than it."""
    expr = None
    for suf in STEM_SUFFIXES:
        cond = (F.length(t) > len(suf) + 3) & t.endswith(suf)
        cut = F.substr(t, F.lit(1), F.length(t) - len(suf))
        expr = F.when(cond, cut) if expr is None else expr.when(cond, cut)
    return expr.otherwise(t)


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)


def tokens_of(words: Column) -> Column:
    """The tokens of an array of raw words: the words, identifiers also as their
    ``_`` parts; length >= 2, not a stop word; suffix-stemmed."""
    parts = F.flatten(
        F.transform(words, lambda w: F.when(F.instr(w, "_") > 0, F.concat(F.array(w), F.filter(F.split(w, "_"), lambda p: p != ""))).otherwise(F.array(w)))
    )
    kept = F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))
    return F.transform(kept, stem)


def tokens(text: Column) -> Column:
    """Words ``[a-z0-9_]+``; identifiers also as their ``_`` parts; length
    >= 2, not a stop word; suffix-stemmed. An array (with repeats)."""
    return tokens_of(raw_words(text))


def distinct_tokens(text: Column) -> Column:
    """The distinct ones of ``tokens``; a word that repeats is looked at once."""
    return F.array_distinct(tokens_of(F.array_distinct(raw_words(text))))


def query_terms(text: Column) -> Column:
    """Distinct query tokens plus the tokens of the synonyms of each raw word."""
    syn = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.lit(" ".join(v)))])
    extra = F.transform(raw_words(text), lambda w: F.coalesce(syn[w], F.lit("")))
    return F.array_distinct(F.concat(tokens(text), tokens(F.array_join(extra, " "))))


def page_focus(text: Column) -> Column:
    """Title and body lines of a page: stop at the '## Autonomy' heading,
    keep '# ' titles without the marker, drop other headings, blank lines and
    the 'Problem ID:' line; joined by spaces."""
    lines = F.split(text, "\n")
    stop = F.array_position(F.transform(lines, lambda l: l.startswith("## Autonomy")), F.lit(True))
    upto = F.when(stop > 0, F.slice(lines, 1, (stop - 1).cast("int"))).otherwise(lines)
    kept = F.filter(
        F.transform(upto, lambda l: F.when(l.startswith("# "), F.substr(l, F.lit(3))).when(
            (l == "") | l.startswith("#") | l.startswith("Problem ID:"), F.lit(None)
        ).otherwise(l)),
        lambda l: l.isNotNull(),
    )
    return F.array_join(kept, " ")


def words_of(text: Column) -> Column:
    """Whitespace-separated words (no empty strings)."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_grams(words: Column, n: int = 4) -> Column:
    """Word n-grams of a words array. Pass a column reference (not an
    expression): the lambda reads it once per gram."""
    idx = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(idx, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def hashed(words: Column) -> Column:
    """The 64-bit hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def hashed_grams(hashes: Column, n: int = 4) -> Column:
    """Word n-grams of an array of word hashes, as a hash each. Pass a column
    reference (not an expression)."""
    idx = F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0)))
    return F.when(F.size(hashes) >= n, F.transform(idx, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))).otherwise(
        F.array().cast("array<bigint>")
    )


# The cited-problem pattern of an answer ("Problem B1: ...").
CITED_PATTERN = r"Problem\s+([A-O]\d{1,2}|none)\b"


def cited_problem(answer: Column) -> Column:
    """The problem id an answer cites, NULL when none is cited."""
    got = F.regexp_extract(answer, CITED_PATTERN, 1)
    return F.when((got == "") | (got == "none"), F.lit(None)).otherwise(got)


def as_number(value: Column) -> Column:
    """Loosely typed value as a double (NULL when not a number)."""
    return value.cast("string").try_cast("double")


def last_part(name: Column) -> Column:
    """Last part of a dotted name (``catalog.schema.table`` -> ``table``)."""
    return F.element_at(F.split(name, r"\."), -1)
