"""Scalar functions on texts, values, dates and arrays, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelstack.functions.batches import lean

WORD = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits in order; null for null."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\p{Z}]|[\p{Cf}&&[^\x{200C}\x{200D}]]", "")


def match_value(value: Column | str) -> Column:
    """NFKC without white space and format characters (joiners stay), twice normalised. Every row passes through Python; ``normalised`` spares ASCII rows that."""
    return _nfkc(_bare(_nfkc(_col(value))))


def comparison_text(value: Column | str) -> Column:
    """NFKC, case-folded, without white space: equal texts read alike. As ``match_value``, for a column of few rows."""
    return F.regexp_replace(_casefold(_col(value)), r"[\s\p{Z}]", "")


def normalised(df: DataFrame, column: str, match: str | None = None, comparison: str | None = None) -> DataFrame:
    """Add a match value and/or a comparison text of a column, under the names given.

    The match value is NFKC without white space and format characters (joiners stay), twice normalised; texts whose comparison
    texts are equal read alike: NFKC, case-folded, without white space. Rows of ASCII text (and nulls) never leave the JVM: only the others
    pass through Python, as the second part of a union, in batches bounded by their bytes.
    """
    df = lean(df)
    c, ascii_only = F.col(column), F.coalesce(F.octet_length(column) == F.length(column), F.lit(True))
    made = lambda m, k: {n: e for n, e in ((match, m), (comparison, k)) if n}
    plain = df.where(ascii_only).withColumns(made(F.regexp_replace(c, r"\s", ""), F.regexp_replace(F.lower(c), r"\s", "")))
    wide = df.where(~ascii_only).withColumns(made(_nfkc(_bare(_nfkc(c))), F.regexp_replace(_casefold(c), r"[\s\p{Z}]", "")))
    return plain.unionByName(wide)


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(F.trim(_col(value)), F.lit(""))


def token_form(token: Column | str) -> Column:
    """A ``form/pos`` token without what follows its last slash."""
    return F.regexp_replace(_col(token), r"/[^/]*$", "")


def damaged(text: Column | str) -> Column:
    """Whether a text was decoded wrongly: it holds the replacement character."""
    return F.coalesce(F.contains(_col(text), F.lit("�")), F.lit(False))


def error_rate(expected: Column, observed: Column) -> Column:
    """Edit distance over expected length; 0 if both are empty, null if only the expected text is."""
    n = F.length(expected)
    return F.when(n > 0, F.levenshtein(expected, observed) / n).when(F.length(observed) == 0, F.lit(0.0))


def fingerprint(*fields: Column | str) -> Column:
    """SHA-256 over the UTF-8 bytes of each field, each behind its length as four big-endian bytes."""
    part = lambda f: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(f).cast("long")), 8, "0")), F.encode(f, "UTF-8"))
    return F.sha2(F.concat(*[part(F.coalesce(_col(f), F.lit(""))) for f in fields]), 256)


def canonical_filters(filters: Column) -> Column:
    """Map of filter name to values: values trimmed, lower-cased, distinct and sorted, empty lists gone, names sorted."""
    clean = F.transform_values(filters, lambda _, v: F.array_sort(F.array_distinct(F.filter(F.transform(v, lambda x: F.lower(F.trim(x))), lambda x: x != ""))))
    return F.map_from_entries(ordered_keys(F.map_entries(F.map_filter(clean, lambda _, v: F.size(v) > 0))))


def text_key(token_list: Column, raw: Column | str) -> Column:
    """Twelve hex digits that identify an observation's text: of its tokens, or of the raw text if there are none."""
    material = F.when(F.size(token_list) > 0, F.concat(F.lit("tok:"), F.array_join(token_list, " "))).otherwise(F.concat(F.lit("raw:"), _col(raw)))
    return F.substring(F.sha2(material.cast("binary"), 256), 1, 12)


def period_start(text: Column | str) -> Column:
    """First day of a date text ``yyyy``, ``yyyy-mm`` or ``yyyy-mm-dd``; null if it is none."""
    t = F.trim(_col(text))
    day = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    return F.try_to_date(day, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(day)


def period_end(text: Column | str) -> Column:
    """Day after a date text's period."""
    t, start = F.trim(_col(text)), period_start(text)
    return F.when(F.length(t) == 4, F.add_months(start, 12)).when(F.length(t) == 7, F.add_months(start, 1)).otherwise(F.date_add(start, 1))


def last_day_text(end_exclusive: Column | str) -> Column:
    """Inclusive last day, as text, of a window that ends before ``end_exclusive``."""
    return F.date_format(F.date_sub(_col(end_exclusive), 1), "yyyy-MM-dd")


def confidence_band(confidence: Column | str) -> Column:
    c = _col(confidence)
    return F.when(c.isNull(), "none").when(c < 0.5, "low").when(c < 0.8, "mid").otherwise("high")


def without_fence(text: Column | str) -> Column:
    """A model's answer without a surrounding Markdown code fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(text)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: one more for each character beyond the basic plane."""
    return (F.octet_length(F.encode(_col(text), "UTF-16BE")) / 2).cast("long")


def utf16_index(text: Column | str, at: Column) -> Column:
    """Index in UTF-16 units of the code point at ``at``."""
    return utf16_length(F.substring(_col(text), F.lit(1), at.cast("int")))


def code_point_index(text: Column | str, unit: Column) -> Column:
    """Code points before a UTF-16 unit; a unit inside a pair counts as after it."""
    raw = F.encode(_col(text), "UTF-16BE")
    return F.length(F.decode(F.substring(raw, F.lit(1), (2 * unit).cast("int")), "UTF-16BE")).cast("long")


def occurrences(text: Column | str, value: Column | str) -> Column:
    """Starts of all matches of a value in a text that do not overlap, in code points from 0."""
    t, v = _col(text), _col(value)
    pieces = F.split(t, F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("found"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + F.length(v)).alias("at"), F.concat(acc["found"], F.array((acc["at"] + F.length(x)).cast("long"))).alias("found"))
    found = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["found"])
    return F.when(F.length(v) > 0, found).otherwise(F.array().cast("array<bigint>"))


def ordered_keys(entries: Column) -> Column:
    """Map entries in the order of their keys' UTF-16 units."""
    keyed = F.transform(entries, lambda e: F.struct(F.encode(e["key"], "UTF-16BE").alias("unit"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def version_id(schema: Column, settings: Column) -> Column:
    """``schema:`` and the first eight digits of the hash of the settings (a map of text to text) as JSON with sorted keys."""
    text = F.to_json(F.map_from_entries(ordered_keys(F.map_entries(settings))))
    return F.concat(schema, F.lit(":"), F.substring(F.sha2(text.cast("binary"), 256), 1, 8))


def ngram_join(words: Column, n: int) -> Column:
    """Neighbouring ``n`` words joined without a gap."""
    count = F.size(words) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), ""))).otherwise(F.array().cast("array<string>"))


def bucket(value: Column, epsilon: float) -> Column:
    """Floor bucket of a score; the score itself for ``epsilon`` 0."""
    return F.floor(value / epsilon).cast("double") if epsilon > 0 else value
