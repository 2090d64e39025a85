from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from portlens.operators.catalog import (
    catalog_from_rows,
    compatibility_mapping,
    documented_baseline,
    empty_mapping,
    enrich_support,
    mapping_order,
    merge_baseline,
)
from portlens.plans.catalog_sync import catalog_baseline, sync
from portlens.sources.pages import page_metadata, reference_rows, resolve_link, support_rows, support_tables, text_lines
from portlens.sources.rules import built_in_rules
from portlens.sources.snapshots import load_catalog, load_run, load_table, save_catalog, save_run, save_table
from portlens.sources.supplemental import EntryFields, supplemental_entries

PAGE = """<h1>Top</h1><table><tr><th>Command</th><th>Support (Since)</th></tr>
<tr><td>find</td><td>19c</td></tr><tr><td> </td><td></td></tr><tr><td>drop&nbsp;it</td><td>Not <b>supported</b></td><td>extra</td></tr></table>
<table><tr><td>Alone</td></tr></table><h3 class="x">Lower &amp; deeper</h3>
<TABLE><TR><TH>operator</TH><TH>Supported?</TH><TH>Supported?</TH></TR><TR><TD>$gt</TD><TD>yes</TD></TR></TABLE>"""


def test_support_tables(spark):
    pages = spark.createDataFrame([(1, "http://x/y", PAGE), (2, "http://x/z", "<p>none</p>")], "page_id LONG, url STRING, html STRING")
    rows = support_tables(pages).orderBy("page_id", "table_index", "row_index").collect()
    assert [(r.table_index, r.section, r.cells) for r in rows] == [
        (1, "Top", {"Command": "find", "Support (Since)": "19c", "column_3": ""}),
        (1, "Top", {"Command": "drop it", "Support (Since)": "Not supported", "column_3": "extra"}),
        (2, "Lower & deeper", {"Operator": "$gt", "Supported?": "yes", "Supported?_2": ""}),
    ]
    assert [r.command for r in support_rows(pages).orderBy("row_id").collect()] == ["find", "drop it", ""]


@pytest.mark.parametrize(
    "link, url",
    [
        ("", "http://h/a/b/c.html?q=1#f"),
        ("#x", "http://h/a/b/c.html?q=1#x"),
        ("d.html", "http://h/a/b/d.html"),
        ("./d.html", "http://h/a/b/d.html"),
        ("../d/e", "http://h/a/d/e"),
        ("../../../d", "http://h/d"),
        ("/d", "http://h/d"),
        ("//k/d", "http://k/d"),
        ("https://k/d", "https://k/d"),
        ("?z=2", "http://h/a/b/c.html?z=2"),
    ],
)
def test_links(spark, link, url):
    frame = spark.createDataFrame([("http://h/a/b/c.html?q=1#f", link)], "base STRING, link STRING")
    assert frame.select(resolve_link(F.col("base"), F.col("link"))).first()[0] == url


REFERENCE = """<h4>Group</h4><table><tr><th>Stage</th><th>Description</th></tr><tr><td><a href="m.html">$match</a></td><td>Filters</td></tr>
<tr><td>$only</td></tr><tr><td></td><td>x</td></tr></table><table><tr><th>Name</th></tr><tr><td>n</td></tr></table>
<h2>Next</h2><table><tr><th>Description</th><th>Name</th></tr><tr><td>Second</td><td>$match</td></tr></table>"""
REFERENCE_SCHEMA = "page_id LONG, url STRING, entity_type STRING, source_group STRING, source_label STRING, html STRING"


def reference_pages(spark):
    return spark.createDataFrame([(7, "http://h/r/p.html", "stage", "aggregation_stage", "Stages", REFERENCE)], REFERENCE_SCHEMA)


def test_reference_rows_and_first_entry(spark):
    rows = reference_rows(reference_pages(spark)).orderBy("ordinal").collect()
    assert [(r.category, r.name, r.short_description, r.doc_url) for r in rows] == [
        ("Group", "$match", "Filters", "http://h/r/m.html"),
        ("Next", "$match", "Second", "http://h/r/p.html"),
    ]
    catalog = catalog_from_rows(reference_rows(reference_pages(spark))).collect()
    assert [(r.name, r.short_description) for r in catalog] == [("$match", "Filters")] and len(catalog[0].content_hash) == 64


def test_pages_of_one_file_are_dealt_over_tasks(spark):
    """One partition of many pages is read by many tasks, copies and null keys included."""
    ids = spark.range(0, 5000, 1, 1).selectExpr("IF(id < 10, NULL, id) AS page_id", "concat('http://x/', id) AS url")
    pages = ids.withColumns({"html": F.lit(PAGE), "entity_type": F.lit("command"), "source_group": F.lit("command"), "source_label": F.lit("Label")})
    rows, one = support_rows(pages), support_rows(pages.filter("page_id = 77"))
    assert rows.rdd.getNumPartitions() == 3 and one.rdd.getNumPartitions() == 1
    assert rows.count() == 5000 * one.count() > 0
    assert reference_rows(pages).rdd.getNumPartitions() == 3


def test_page_text(spark):
    html = "<!DOCTYPE html><title>A</title><script>var x='F12345-99'</script><!-- March 2001 --><p>My  API &lt;x&gt;</p><p>F12345-01, 12 May 2024</p><p>This\nmanual reflects version 8.0 of it</p>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id LONG, url STRING, html STRING")
    assert pages.select(text_lines("html")).first()[0][:3] == ["A", "My API <x>", "F12345-01, 12 May 2024"]
    row = page_metadata(pages, "API").first()
    assert (row.doc_title, row.doc_id, row.doc_version_date, row.manual_version) == ("My API <x>", "F12345-01", "May 2024", "8.0")


def test_loose_match_needs_a_single_entry(spark):
    catalog = spark.createDataFrame(
        [("operator", "update_operator", "$set"), ("operator", "query_operator", "$in"), ("operator", "expression_operator", "$in")],
        "entity_type STRING, source_group STRING, name STRING",
    ).withColumns({c: F.concat_ws("/", F.lit(c), "source_group") for c in ("short_description", "doc_url", "category", "last_synced_at")})
    support = spark.createDataFrame(
        [(1, "Query", "$in"), (2, "Else", "$set"), (3, "Projection", "$in")], "row_id LONG, section STRING, operator STRING"
    ).withColumns({"command": F.lit(""), "stage": F.lit("")})
    got = {r.row_id: r.source_short_description for r in enrich_support(support, catalog).collect()}
    assert got == {1: "short_description/query_operator", 2: "short_description/update_operator", 3: ""}


def catalog_frame(spark, rows):
    names = ["ordinal", "entity_type", "source_group", "category", "name", "short_description", "doc_url", "source_page_url"]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'LONG' if c == 'ordinal' else 'STRING'}" for c in names))


def test_baseline_and_mapping(spark, tmp_path):
    catalog = catalog_frame(
        spark,
        [
            (3, "operator", "query_operator", "B", "$in", "", "u3", "p1"),
            (1, "operator", "update_operator", "A", "$in", " ", "u1", "p2"),
            (2, "operator", "query_operator", "A", "$in", "text", "u2", "p1"),
            (4, "command", "command", "C", "find", "reads", "u", "p"),
        ],
    )
    listed = supplemental_entries(
        spark.createDataFrame(
            [("s.json", '{"find":{"doc_categories":[{"category_level_0":"X","category_level_1":""}],"ignore":true},"$new":{"doc_categories":null},"Big":{},"a b":{}}')],
            "source_ref STRING, document STRING",
        )
    )
    merged = merge_baseline(documented_baseline(catalog, "8.0"), listed, "8.0")
    rows = {r.feature_name: r for r in merged.collect()}
    assert set(rows) == {"$in", "find", "$new"}
    assert (rows["$in"].source_group, rows["$in"].source_category, rows["$in"].source_short_description, rows["$in"].source_doc_url) == (
        "update_operator | query_operator",
        "A | B",
        "text",
        "u1",
    )
    assert (rows["find"].baseline_source_kind, rows["find"].admin_operational_flag, rows["find"].availability_notes) == (
        "reference_docs | supplemental_json",
        True,
        "Supplemental categories: X",
    )
    assert (rows["$new"].source_group, rows["$new"].source_manual_version) == ("expression_operator", "8.0")
    support = spark.createDataFrame(
        [("Q", "", "", "$in", "19c"), ("Q", "", "", "$in", "19c"), ("R", "", "", "$in", "26ai"), ("Q", "FIND", "", "", "19c")],
        "section STRING, command STRING, stage STRING, operator STRING, support_since STRING",
    )
    mapping = compatibility_mapping(merged, support)
    listing = [(r.feature_name, r.target_matched, r.target_support_since) for r in mapping.orderBy(*mapping_order()).collect()]
    assert listing == [("find", False, ""), ("$in", True, "19c"), ("$in", True, "26ai"), ("$new", False, "")]
    assert {r.target_uncovered_reason for r in empty_mapping(merged).collect()} == {"target_mapping_not_built"}
    save_catalog(merged, mapping, str(tmp_path))
    again, links = load_catalog(spark, str(tmp_path))
    assert {tuple(r) for r in again.select(*merged.columns).collect()} == {tuple(r) for r in merged.collect()}
    assert links.filter("target_matched").count() == 2


def test_sync_and_catalog_baseline(spark):
    support_pages = spark.createDataFrame([(1, "http://x/y", PAGE)], "page_id LONG, url STRING, html STRING")
    rules = built_in_rules(spark)
    result = sync(support_pages, reference_pages(spark), rules, version="19c", mode="op", synced_at="now")
    row = result.assessed.first()
    assert (row.feature_name, row.target_matched, row.target_support_statuses, row.source_short_description) == ("$match", False, "Unknown", "Filters")
    usage = spark.createDataFrame([("command", "find", 5, "find")], "feature_type STRING, feature_name STRING, usage_count LONG, command_name STRING")
    table = {r.feature_name: r for r in catalog_baseline(result.support, usage, rules, None, "19c", "op").collect()}
    assert (table["find"].observed_in_profile, table["find"].observed_usage_count, table["find"].effective_complexity) == (True, 5, "Low")
    assert (table["drop it"].observed_in_profile, table["drop it"].effective_complexity) == (False, "High") or table["drop it"].effective_scope != "application_api"


def test_saved_runs(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([("a", 1)], "feature_name STRING, usage_count LONG")
    new = spark.createDataFrame([("b", 2, "x")], "feature_name STRING, usage_count LONG, op_type STRING")
    save_run(spark, root, "20240101_000000", {"detail": old, "summary": old}, {"note": "ünï"})
    save_run(spark, root, "20240102_000000", {"detail": new, "summary": old, "migration_detail": new}, {"note": "two"})
    newest = load_run(spark, root)
    assert [r.feature_name for r in newest["detail"].collect()] == ["b"] and set(newest) == {"detail", "summary", "migration_detail", "metadata"}
    first = load_table(spark, root, "detail", "20240101_000000").first()
    assert (first.feature_name, first.op_type) == ("a", None)
    assert '"ünï"' in load_table(spark, root, "metadata", "20240101_000000").first().metadata
    save_table(old.limit(0), root, "detail", "20240103_000000")
    assert load_table(spark, root, "detail", "20240102_000000").count() == 1


def test_supplemental_field_names(spark):
    documents = spark.createDataFrame([("r", '{"$a":{"cats":[{"category_level_0":"Update Operators"}],"skip":true}}')], "source_ref STRING, document STRING")
    row = supplemental_entries(documents, EntryFields(categories="cats", ignore="skip")).first()
    assert (row.source_group, row.admin_operational_flag) == ("update_operator", True)
