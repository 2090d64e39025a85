"""Support tables, reference tables and metadata in documentation pages.

Each page is read on its own by array expressions. Pages of tables are dealt
over many tasks first, since reading one is costly.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from portlens import fixed
from portlens.functions.text import ColumnOrName, clean_text, col
from portlens.session import spread

_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
_CELL = r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"
_HEAD = r"(?is)<th\b[^>]*>(.*?)</th>"
_LINK = r'(?is)<a\b[^>]*?\bhref\s*=\s*["\']([^"\']*)["\']'
# What follows an ampersand in a character reference, up to the semicolon.
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# Named character references, as the standard library lists them; a fixed space is a space.
_NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def _character(name: Column) -> Column:
    """The character that a reference of this name stands for; NULL if there is none."""
    digits = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(
        name.startswith("#"), F.substring(name, F.lit(2), F.length(name))
    )
    code = digits.cast("bigint")
    code = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code)
    character = F.when(code == 0xA0, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    # A constant: the optimizer reads it once.
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    return F.when(name.startswith("#"), character).otherwise(F.element_at(named, name))


def decoded(text: Column) -> Column:
    """A text with its character references replaced, each read once.

    The text is cut at its ampersands, so it is computed once and no character
    that came out of a reference is read as part of another.
    """
    named = F.transform(F.split(text, "&"), lambda p, i: F.struct(p.alias("p"), F.when(i > 0, F.regexp_extract(p, _REFERENCE, 1)).alias("name")))

    def joined(x: Column) -> Column:
        rest = F.substring(x["p"], F.length(x["name"]) + 2, F.length(x["p"]))
        return F.when(x["name"].isNull(), x["p"]).otherwise(F.coalesce(F.when(x["name"] != "", F.concat(_character(x["name"]), rest)), F.concat(F.lit("&"), x["p"])))

    return F.array_join(F.transform(named, joined), "")


def inner_text(html: ColumnOrName) -> Column:
    """Text of a fragment: tags become spaces, character references are decoded."""
    return clean_text(decoded(F.regexp_replace(col(html), r"(?s)<[^>]*>", " ")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def tables_under_headings(html: ColumnOrName, lowest: int) -> Column:
    """Array of (heading, html) for every table, in the order of their opening tags.

    The heading is the nearest one above the table, down to level `lowest`. The
    page is cut before each heading and each opening and closing table tag, and
    the pieces are folded with the tables that are open at each. A table inside
    a cell is a table of its own; in the outer one its text is part of the cell,
    without tags. A table that is never closed ends with what it lies in.
    """
    pieces = F.split(col(html), rf"(?i)(?=<h[1-{lowest}]\b|</?table\b)")
    begin = F.expr(
        "named_struct('open', CAST(array() AS array<int>), 'n', 0, 'heading', '', 'heads', CAST(array() AS array<string>), "
        "'parts', CAST(array() AS array<struct<open: array<int>, html: string>>))"
    )

    def step(s: Column, piece: Column) -> Column:
        tag = F.lower(F.substring(piece, 1, 7))
        opens, closes = tag.startswith("<table"), tag == "</table"
        now = F.when(opens, F.concat(s["open"], F.array(s["n"]))).when(closes, F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        return F.get(F.transform(F.array(now), lambda x: F.struct(
            x.alias("open"),
            F.when(opens, s["n"] + 1).otherwise(s["n"]).alias("n"),
            F.when(tag.rlike(r"^<h[1-9]"), piece).otherwise(s["heading"]).alias("heading"),
            F.when(opens, F.concat(s["heads"], F.array(s["heading"]))).otherwise(s["heads"]).alias("heads"),
            F.when(F.size(x) > 0, F.concat(s["parts"], F.array(F.struct(x.alias("open"), piece.alias("html"))))).otherwise(s["parts"]).alias("parts"),
        )), F.lit(0))

    def found(s: Column) -> Column:
        def table(head: Column, t: Column) -> Column:
            mine = F.filter(s["parts"], lambda p: F.array_contains(p["open"], t))
            texts = F.transform(mine, lambda p: F.when(F.element_at(p["open"], -1) == t, p["html"]).otherwise(F.regexp_replace(p["html"], r"(?s)<[^>]*>", " ")))
            heading = inner_text(F.regexp_extract(head, rf"(?is)^<h[1-{lowest}]\b[^>]*>(.*?)</h[1-{lowest}]>", 1))
            return F.struct(heading.alias("heading"), F.array_join(texts, "").alias("html"))

        return F.transform(s["heads"], table)

    return F.aggregate(pieces, begin, step, found)


def _rows_of(table: Column) -> Column:
    rows = F.transform(_matches(table, _ROW), lambda r: F.transform(_matches(r, _CELL), inner_text))
    return F.filter(rows, lambda r: F.size(r) > 0)


def canonical_header(header: Column) -> Column:
    """Column names of a table: known ones in their usual spelling, repeats numbered."""

    def usual(name: Column) -> Column:
        low = F.lower(name)
        return (
            F.when(low.contains("support") & low.contains("since"), "Support (Since)")
            .when(low == "command", "Command")
            .when(low == "operator", "Operator")
            .when(low == "stage", "Stage")
            .otherwise(name)
        )

    def numbered(named: Column) -> Column:
        times = lambda name, i: F.size(F.filter(F.slice(named, 1, i + 1), lambda x: x == name))
        return F.transform(named, lambda name, i: F.when(times(name, i) > 1, F.concat(name, F.lit("_"), times(name, i).cast("string"))).otherwise(name))

    return _once(F.transform(header, lambda h: _once(clean_text(h), usual)), numbered)


def support_tables(pages: DataFrame) -> DataFrame:
    """Rows of all support tables: (page_id, table_index, row_index, section, cells).

    A table counts when a column name contains "support". Short rows are
    padded; columns beyond the header are called `column_<n>`. `cells` maps
    column names to texts, since every table has its own columns.
    """
    found = F.transform(
        tables_under_headings("html", 3),
        lambda t: F.struct(
            F.when(t.heading == "", "Unknown Section").otherwise(t.heading).alias("section"), _rows_of(t.html).alias("rows")
        ),
    )

    def shaped(t: Column) -> Column:
        header = F.get(t.rows, F.lit(0))
        width = F.array_max(F.transform(t.rows, F.size))
        extra = F.filter(
            F.transform(F.sequence(F.lit(0), width), lambda i: F.when((i >= F.size(header)) & (i < width), F.concat(F.lit("column_"), (i + 1).cast("string")))),
            lambda x: x.isNotNull(),
        )
        return F.struct(
            t.section.alias("section"), canonical_header(F.concat(header, extra)).alias("header"), F.slice(t.rows, 2, F.size(t.rows)).alias("body")
        )

    usable = F.filter(
        F.transform(F.filter(found, lambda t: F.size(t.rows) > 1), shaped),
        lambda t: F.exists(t.header, lambda h: F.lower(h).contains("support")),
    )
    # The outer form computes the array once for each page (see `usage._one_per_row`).
    tables = spread(pages.select("page_id", "html")).select("page_id", F.posexplode_outer(usable).alias("n", "t")).filter(F.col("t").isNotNull())
    rows = tables.select("page_id", (F.col("n") + 1).alias("table_index"), "t.section", "t.header", F.posexplode("t.body").alias("row_index", "row"))
    padded = F.transform(F.col("header"), lambda _h, i: F.coalesce(F.get(F.col("row"), i), F.lit("")))
    return rows.select("page_id", "table_index", "row_index", "section", F.map_from_arrays("header", padded).alias("cells")).filter(
        F.exists(F.map_values("cells"), lambda v: v != "")
    )


def support_rows(pages: DataFrame) -> DataFrame:
    """Support tables in the fixed columns the rest of the library reads.

    `row_id` holds the place (page, table, row), and so follows page order.
    """
    cells = lambda name: F.coalesce(F.col("cells")[name], F.lit(""))
    return support_tables(pages).select(
        F.struct("page_id", "table_index", "row_index").alias("row_id"),
        "page_id",
        "table_index",
        "section",
        cells("Command").alias("command"),
        cells("Operator").alias("operator"),
        cells("Stage").alias("stage"),
        cells("Support (Since)").alias("support_since"),
    )


def resolve_link(base: Column, link: Column) -> Column:
    """A link as seen from its page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.regexp_replace(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"[^/]*$", "")).otherwise("/")
    # A climb in front of the link removes one folder from the end.
    climbs = F.length(F.regexp_extract(link, r"^((?:\.\./)*)", 1)) / 3
    rest = F.regexp_replace(link, r"^(?:\.\.?/)+", "")
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - climbs.cast("int"), F.lit(0)))
    climbed = F.concat(origin, F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, "/").otherwise(""), rest)
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(climbed)
    )


def reference_rows(pages: DataFrame) -> DataFrame:
    """Entries of reference tables; `ordinal` holds their place (page, table, row).

    `pages` says for each page what it documents: entity_type, source_group
    and source_label. A table counts when it has a Description column and one
    for the name.
    """
    found = F.transform(
        tables_under_headings("html", 4),
        lambda t: F.struct(t.heading.alias("heading"), F.transform(_matches(t.html, _HEAD), inner_text).alias("head"), _matches(t.html, _ROW).alias("rows")),
    )
    name_at = lambda head: F.coalesce(
        *[F.nullif(F.array_position(head, F.lit(n)), F.lit(0)) for n in ("Name", "Stage", "Command")]
    )
    usable = F.filter(found, lambda t: F.array_contains(t.head, "Description") & name_at(t.head).isNotNull())
    source = ["page_id", "url", "entity_type", "source_group", "source_label"]
    tables = spread(pages.select(*source, "html")).select(*source, F.posexplode_outer(usable).alias("table_no", "t")).filter(F.col("t").isNotNull())
    rows = tables.select(
        *source,
        "table_no",
        F.col("t.heading").alias("heading"),
        name_at(F.col("t.head")).alias("name_at"),
        F.array_position("t.head", F.lit("Description")).alias("text_at"),
        F.posexplode(F.slice("t.rows", 2, F.size("t.rows"))).alias("row_no", "row"),
    )

    def entry(cells: Column) -> Column:
        cell = lambda at: F.get(cells, F.col(at).cast("int") - 1)
        link = F.regexp_extract(cell("name_at"), _LINK, 1)
        return F.struct(
            inner_text(cell("name_at")).alias("name"),
            inner_text(cell("text_at")).alias("short_description"),
            _once(link, lambda x: resolve_link(F.col("url"), x)).alias("doc_url"),
        )

    # Unnested, so that the filter below reads the texts and does not compute them again.
    opened = rows.select(*source, "table_no", "row_no", "heading", F.inline_outer(F.transform(F.array(_matches(F.col("row"), _CELL)), entry)))
    return opened.select(
        F.struct("page_id", "table_no", "row_no").alias("ordinal"),
        "entity_type",
        "source_group",
        F.when(F.col("heading") == "", F.col("source_label")).otherwise(F.col("heading")).alias("category"),
        "name",
        "short_description",
        "doc_url",
        F.col("url").alias("source_page_url"),
        "source_label",
    ).filter((F.col("name") != "") & (F.col("short_description") != ""))


def text_lines(html: ColumnOrName) -> Column:
    """Visible text of a page, one line per text node."""
    visible = F.regexp_replace(col(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<!doctype[^>]*>", "")
    text = F.regexp_replace(visible, r"(?s)<[^>]*>", "\n")
    return F.filter(F.transform(F.split(decoded(text), r"[\r\n]+"), clean_text), lambda line: line != "")


def page_metadata(pages: DataFrame, title_mark: str) -> DataFrame:
    """Document id, version date, manual version and title of each page."""
    lines = pages.select("page_id", "url", text_lines("html").alias("lines")).withColumn("text", F.array_join("lines", "\n"))
    title = F.get(F.filter("lines", lambda line: line.contains(title_mark)), F.lit(0))
    return lines.select(
        "page_id",
        F.col("url").alias("doc_source_url"),
        F.coalesce(title, F.lit("")).alias("doc_title"),
        F.regexp_extract("text", fixed.DOC_ID_PATTERN, 0).alias("doc_id"),
        F.regexp_extract("text", fixed.MONTH_YEAR_PATTERN, 0).alias("doc_version_date"),
        F.regexp_extract(F.regexp_replace("text", r"\s+", " "), fixed.MANUAL_VERSION_PATTERN, 1).alias("manual_version"),
    )
