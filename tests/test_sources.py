from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from portlens.functions.text import checked_window, database_of_uri, json_or_blank, preview_list
from portlens.operators import usage as usage_module
from portlens.operators.events import normalize_events
from portlens.operators.usage import as_evidence, usage_counts, usage_rollup
from portlens.sources.counters import command_counters, counter_value, operator_counters, stage_counters
from portlens.sources.evidence import choose_evidence, confidence
from portlens.sources.logs import log_usage, read_log
from portlens.sources.pages import inner_text
from portlens.sources.profile import PROFILE_COLUMNS, database_totals, newest, read_profile, scan_profile


def profile_frame(spark, rows):
    kinds = {"event_key": "LONG", "ts": "TIMESTAMP_NTZ", "millis": "LONG", "nreturned": "LONG", "docsExamined": "LONG", "keysExamined": "LONG", "errCode": "LONG"}
    schema = ", ".join(f"{c} {kinds.get(c, 'STRING')}" for c in PROFILE_COLUMNS)
    return spark.createDataFrame([(key, ts, ns, *[None] * (len(PROFILE_COLUMNS) - 3)) for key, ts, ns in rows], schema)


def test_scan_filters(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, at(1), "a.c"), (2, at(2), "a.system.profile"), (3, at(3), "admin.c"), (4, at(4), "b.c"), (5, at(5), "a.c")]
    frame = profile_frame(spark, rows)
    keys = lambda f: sorted(r.event_key for r in f.collect())
    assert keys(scan_profile(frame)) == [1, 4, 5]
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01", "2024-01-04"))
    assert keys(scan_profile(frame, start=start, end=end)) == [1, 4]
    assert keys(scan_profile(frame, databases=["admin", "b"])) == [3, 4]


@pytest.mark.parametrize("limit", [1, 7, 60, 500])
def test_newest_matches_brute_force(spark, limit):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for n in range(400):
        # One database has most records, many of them in the same second.
        owner = "hot" if n % 10 else f"db{n % 3}"
        moment = None if n % 97 == 0 else base + dt.timedelta(hours=(n * 7) % 5, seconds=(n * 13) % 4, microseconds=n % 3)
        rows.append((n, moment, f"{owner}.c"))
    want = []
    for owner in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == owner), key=lambda r: (r[1] is None, -(r[1] - base).total_seconds() if r[1] else 0, r[0]))
        want += [r[0] for r in mine[:limit]]
    frame = profile_frame(spark, rows)
    assert sorted(r.event_key for r in newest(frame, limit).collect()) == sorted(want)
    totals = {r.db_name: (r.profile_count, r.truncated) for r in database_totals(frame, limit).collect()}
    assert totals["hot"] == (min(360, limit), 360 > limit)


def test_log_lines(spark):
    good = {"c": "COMMAND", "t": {"$date": "2024-01-01T00:00:00Z"}, "attr": {"ns": "a.b.c", "command": {"$db": "a", "find": "b"}}}
    lines = [
        json.dumps(good),
        json.dumps(good | {"c": "NETWORK"}),
        json.dumps({"msg": "Slow query", "attr": {"ns": "a.c", "command": "x"}}),
        json.dumps(good)[:-3],
        json.dumps(good | {"attr": None}),
        json.dumps(good | {"attr": {"ns": "ac", "command": {}}}),
    ]
    rows = log_usage(spark.createDataFrame([(x,) for x in lines], "line STRING")).collect()
    assert sorted((r.feature_name, r.database, r.collection, r.first_seen) for r in rows) == [("find", "a", "b.c", "2024-01-01T00:00:00Z"), ("msg", "a", "c", "")]


@pytest.mark.parametrize(
    "value, count",
    [
        ("5", 5),
        ("5.9", 5),
        ("true", None),
        ('"5"', None),
        ('{"total":7,"failed":1}', 7),
        ('{"total":true,"a":2}', 2),
        ('{"ok":1,"failed":2.5,"on":true}', 3),
        ("{}", None),
        ("[1]", None),
        ("null", None),
        ("9007199254740993", 9007199254740993),
    ],
)
def test_counter_value(spark, value, count):
    frame = spark.createDataFrame([(value,)], "v STRING").select(F.parse_json("v").alias("v"))
    assert frame.select(counter_value("v")).first()[0] == count


def test_counter_rows(spark):
    metrics = {
        "commands": {"find": {"total": 3}, "HELLO": 9, "none": 0},
        "aggStageCounters": {"$a": {"$b": {"$c": 4}, "total": 2}, "list": [{"$d": 1}], "$zero": 0},
        "operatorCounters": {"match": {"$gt": 8}},
    }
    frame = spark.createDataFrame([("i1", json.dumps(metrics)), ("i2", "{}"), ("i3", "broken")], "instance STRING, metrics STRING")
    assert {(r.feature_name, r.usage_count) for r in command_counters(frame).collect()} == {("find", 3), ("HELLO", 9)}
    assert {r.feature_name for r in command_counters(frame, filter_noise=True).collect()} == {"find"}
    stages = {(r.feature_name, r.usage_count, r.sample_path) for r in stage_counters(frame).collect()}
    assert stages == {
        ("$a", 2, "metrics.aggStageCounters.$a"),
        ("$b", 4, "metrics.aggStageCounters.$a.$b"),
        ("$c", 4, "metrics.aggStageCounters.$a.$b.$c"),
    }
    row = operator_counters(frame).first()
    assert (row.feature_name, row.command_name, row.database, row.usage_count) == ("$gt", "unknown", "INSTANCE_LEVEL", 8)


def test_evidence_choice(spark):
    built = []

    def source(name, rows):
        def build():
            built.append(name)
            return spark.createDataFrame(rows, "x INT")

        return build

    candidates = {"PROFILE_ONLY": source("p", []), "LOG_ONLY": source("l", [(1,)]), "METRICS_ONLY": source("m", [(2,)])}
    assert choose_evidence(candidates)[0] == "LOG_ONLY" and built == ["p", "l"]
    assert choose_evidence(candidates, "METRICS_ONLY")[1].first().x == 2
    with pytest.raises(ValueError, match="no source"):
        choose_evidence(candidates, "PROFILE_ONLY")
    with pytest.raises(ValueError, match="unknown strategy"):
        choose_evidence(candidates, "SOMETIMES")
    assert [confidence(s) for s in (["PROFILE_ONLY"], ["LOG_ONLY", "PROFILE_ONLY"], ["LOG_ONLY"])] == ["high", "mixed", "low"]


def test_evidence_rows_share_text_times(spark):
    frame = spark.sql("SELECT 'stage' AS feature_type, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS first_seen, CAST(NULL AS TIMESTAMP_NTZ) AS last_seen")
    row = as_evidence(frame, "profile").first()
    assert (row.first_seen, row.last_seen, row.evidence_source) == ("2024-01-01T00:00:00", "", "profile")


def test_time_window(spark):
    def window(start, end):
        return spark.createDataFrame([(start, end)], "a STRING, b STRING").select(checked_window("a", "b").alias("w")).select("w.*").first()

    assert window("2024-01-01T00:00:00Z", "")[0] == dt.datetime(2024, 1, 1)
    assert window(" ", None) == (None, None)
    with pytest.raises(Exception, match="cannot parse"):
        window("yesterday", "")
    with pytest.raises(Exception, match="after end"):
        window("2024-01-02", "2024-01-01")


@pytest.mark.parametrize(
    "uri, explicit, name",
    [("m://h:1/app%20x?a=b", "", "app x"), ("m://u:p@h1,h2/app", " other ", "other"), ("m://h", "", ""), ("m://h/", None, ""), ("m://h/a+b", "", "a+b"), ("", "", "")],
)
def test_database_of_uri(spark, uri, explicit, name):
    assert spark.createDataFrame([(uri, explicit)], "u STRING, e STRING").select(database_of_uri("u", "e")).first()[0] == name


def test_small_texts(spark):
    frame = spark.createDataFrame([(["a", " ", "b", "c"],), ([],)], "v ARRAY<STRING>")
    assert [r[0] for r in frame.select(preview_list("v", 2)).collect()] == ["a, b ... (total 3)", ""]
    texts = spark.createDataFrame([('{"b":1,"a":[]}',), ("{}",), ("null",)], "j STRING").select(json_or_blank(F.parse_json("j")))
    assert [r[0] for r in texts.collect()] == ['{"a":[],"b":1}', "", ""]


def test_exported_files(spark, tmp_path):
    records = [
        {"ts": {"$date": "2024-01-01T10:00:00.250Z"}, "ns": "a.c", "op": "query", "command": {"find": "c", "filter": {"z": {"$gt": 1}, "a": 2}}, "millis": 7},
        {"ts": "2024-01-02T00:00:00", "ns": "a.c", "op": "update", "query": {"x": 1}, "updateobj": {"$set": {"y": 1}}},
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(r) for r in records))
    frame = read_profile(spark, str(tmp_path / "p.json"))
    rows = normalize_events(scan_profile(frame)).orderBy("ts").collect()
    assert [r.command_name for r in rows] == ["find", "update"] and rows[0].ts == dt.datetime(2024, 1, 1, 10, 0, 0, 250000)
    assert json.loads(rows[0].command_doc) == records[0]["command"] and rows[0].duration_ms == 7
    assert list(json.loads(rows[0].command_doc)["filter"]) == ["z", "a"]
    assert rows[0].event_key != rows[1].event_key
    frame.write.parquet(str(tmp_path / "p.parquet"))
    assert read_profile(spark, str(tmp_path / "p.parquet"), "parquet").count() == 2
    (tmp_path / "log").write_text("one\ntwo")
    assert [r.line for r in read_log(spark, str(tmp_path / "log")).collect()] == ["one", "two"]


@pytest.mark.parametrize("rows, keys", [(0, 10**6), (0, 0)])
def test_samples_do_not_depend_on_the_join(spark, monkeypatch, rows, keys):
    records = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n % 50), f"db{n % 4}.c") for n in range(300)]
    frame = profile_frame(spark, records).withColumns(
        {"op": F.lit("query"), "command": F.format_string('{"find":"c","filter":{"a":{"$gt":%d}}}', "event_key")}
    )
    events = normalize_events(scan_profile(frame))
    want = sorted(map(tuple, usage_rollup(events).collect()))
    monkeypatch.setattr(usage_module, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(usage_module, "BROADCAST_KEYS", keys)
    assert sorted(map(tuple, usage_rollup(events).collect())) == want and usage_counts(events).count() == len(want)


def test_newest_of_records_without_times(spark):
    rows = [(n, None, "hot.c") for n in range(300)] + [(1000 + n, dt.datetime(2024, 1, 1), "hot.c") for n in range(5)]
    frame = profile_frame(spark, rows)
    assert sorted(r.event_key for r in newest(frame, 20).collect()) == [*range(15), *range(1000, 1005)]


def test_character_references(spark):
    frame = spark.createDataFrame([("a&rsquo;s &#8212; b&#x27;c &amp;lt; &lt;p&gt; &nbsp;x &unknown; &#0; &#x1F600;",)], "h string")
    assert frame.select(inner_text("h")).first()[0] == "a\u2019s \u2014 b'c &lt; <p> x &unknown; &#0; \U0001f600"
