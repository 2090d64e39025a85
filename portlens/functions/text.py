"""Text, flag and ordered-label expressions shared by every module."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank(value: ColumnOrName) -> Column:
    """NULL becomes the empty text."""
    return F.coalesce(col(value).cast("string"), F.lit(""))


def squash(value: ColumnOrName) -> Column:
    """Collapse runs of whitespace and trim."""
    return F.trim(F.regexp_replace(blank(value), r"(?U)\s+", " "))


def clean_text(value: ColumnOrName) -> Column:
    """Squash after dropping mis-decoded, zero-width and byte-order marks."""
    return squash(F.translate(blank(value), "\u00a0\u00c2\u200b\ufeff", " "))


def match_key(value: ColumnOrName) -> Column:
    return F.lower(squash(value))


def or_default(value: ColumnOrName, default: ColumnOrName | None) -> Column:
    """`value` squashed, or `default` where nothing is left of it."""
    return F.coalesce(F.nullif(squash(value), F.lit("")), F.lit(default) if isinstance(default, str) else default)


def is_true(value: ColumnOrName) -> Column:
    return F.lower(F.trim(blank(value))).isin("1", "true", "yes", "y")


def true_text(value: ColumnOrName) -> Column:
    return F.when(F.coalesce(col(value), F.lit(False)), "true").otherwise("false")


def json_or_blank(value: ColumnOrName) -> Column:
    """JSON text with sorted keys of a VARIANT; blank for NULL and empty values."""
    text = F.to_json(col(value))
    return F.when(text.isin("{}", "[]", "null", '""', "0", "false"), "").otherwise(F.coalesce(text, F.lit("")))


def preview_list(values: ColumnOrName, limit: int = 5) -> Column:
    """First `limit` non-blank items, with the total where more follow."""
    items = F.filter(F.transform(col(values), lambda x: F.trim(x.cast("string"))), lambda x: x != "")
    head = F.array_join(F.slice(items, 1, limit), ", ")
    total = F.format_string(" ... (total %d)", F.size(items))
    return F.coalesce(F.when(F.size(items) > limit, F.concat(head, total)).otherwise(head), F.lit(""))


def rank_of(value: ColumnOrName, order: Sequence[str]) -> Column:
    """Position of a label in an ordered vocabulary; 0 for anything else."""
    return F.greatest(F.coalesce(F.find_in_set(col(value), F.lit(",".join(order))), F.lit(0)) - 1, F.lit(0))


def higher(left: Column, right: Column, order: Sequence[str]) -> Column:
    return F.when(rank_of(left, order) >= rank_of(right, order), left).otherwise(right)


def lower_of(left: Column, right: Column, order: Sequence[str]) -> Column:
    return F.when(rank_of(left, order) <= rank_of(right, order), left).otherwise(right)


def lookup(value: ColumnOrName, table: Mapping[str, str], default: ColumnOrName) -> Column:
    chain = None
    for key, result in table.items():
        condition = col(value) == key
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    return chain.otherwise(F.lit(default) if isinstance(default, str) else default)


def contains_any(value: Column, parts: Sequence[str]) -> Column:
    result = F.lit(False)
    for part in parts:
        result = result | value.contains(part)
    return result


def share(part: Column, total: Column) -> Column:
    """Percentage with two decimals; an empty total counts as one."""
    return F.round(part / F.greatest(total, F.lit(1)) * 100, 2)


def iso_text(ts: ColumnOrName) -> Column:
    """ISO 8601 text; the fraction is left out where it is zero."""
    text = F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(text, r"\.000000$", "")


def parse_iso(value: ColumnOrName, label: str = "time") -> Column:
    """ISO 8601 text to a timestamp; blank is NULL and anything else fails."""
    text = F.trim(blank(value))
    parsed = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return (
        F.when(text == "", F.lit(None).cast("timestamp"))
        .when(parsed.isNull(), F.raise_error(F.concat(F.lit(f"cannot parse {label}: "), text)).cast("timestamp"))
        .otherwise(parsed)
    )


def checked_window(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Parsed (start, end); fails when the start lies after the end."""
    first, last = parse_iso(start, "start time"), parse_iso(end, "end time")
    late = F.raise_error(F.lit("start time must not be after end time")).cast("timestamp")
    return F.struct(F.when(first > last, late).otherwise(first).alias("start_time"), last.alias("end_time"))


def database_of_uri(uri: ColumnOrName, explicit: ColumnOrName) -> Column:
    """The explicit name, or the decoded path of a connection address."""
    path = F.regexp_extract(F.trim(blank(uri)), r"^[^:/?#]+://[^/?#]*/([^?#]*)", 1)
    decoded = F.trim(F.try_url_decode(F.regexp_replace(F.ltrim(path, F.lit("/")), r"\+", "%2B")))
    return F.coalesce(F.nullif(F.trim(blank(explicit)), F.lit("")), decoded, F.lit(""))
