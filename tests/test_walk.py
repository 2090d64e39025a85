from __future__ import annotations

import datetime as dt
import json
import time
from collections import Counter

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from portlens.operators import tally, walk
from portlens.operators.usage import USAGE_KEYS, feature_details, features, usage_counts, usage_rollup
from portlens.operators.walk import needs_walk

KNOWN = {"find", "aggregate", "insert", "update", "delete", "findAndModify", "distinct", "count", "createIndexes", "dropIndexes", "listIndexes"}
EVENTS = (
    "event_key LONG, ts TIMESTAMP_NTZ, db_name STRING, collection_name STRING, op STRING, command_name STRING, command_doc STRING, duration_ms LONG"
)


def expected(command: str, doc: dict) -> list[tuple]:
    """Brute-force reading of one command: (kind, name, path, value)."""
    found = []

    def dump(value):
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def below(value, path, expression):
        if isinstance(value, dict):
            for key, child in value.items():
                here = f"{path}.{key}"
                if key.startswith("$"):
                    found.append(("expression" if expression else "operator", key, here, dump(child)))
                below(child, here, expression or key == "$expr")
        elif isinstance(value, list):
            for i, child in enumerate(value):
                below(child, f"{path}[{i}]", expression)

    def pipeline(stages):
        for i, stage in enumerate(stages if isinstance(stages, list) else []):
            if not isinstance(stage, dict) or not stage:
                continue
            name, body = next(iter(stage.items()))
            path = f"command.pipeline[{i}].{name}"
            if name.startswith("$"):
                found.append(("stage", name, path, dump(body)))
            if name == "$lookup" and isinstance(body, dict):
                pipeline(body.get("pipeline"))
            elif name == "$facet" and isinstance(body, dict):
                for branch in body.values():
                    pipeline(branch)
            else:
                below(body, path, name != "$match")

    if command in KNOWN:
        found.append(("command", command, f"command.{command}", dump(doc.get(command))))
    if command == "find":
        below(doc.get("filter"), "command.filter", False)
        below(doc.get("projection"), "command.projection", False)
    elif command == "findAndModify":
        below(doc.get("query"), "command.query", False)
        below(doc.get("update"), "command.update", False)
    elif command in ("update", "delete"):
        items = doc.get(f"{command}s")
        for i, item in enumerate(items if isinstance(items, list) else []):
            if isinstance(item, dict):
                for field in ("q", "u") if command == "update" else ("q",):
                    below(item.get(field), f"command.{command}s[{i}].{field}", False)
    elif command == "aggregate":
        pipeline(doc.get("pipeline"))
    return found


def run(spark, documents: list[tuple[str, dict]]):
    layouts = [dict(), dict(separators=(",", ":")), dict(indent=1, separators=(" ,", " : "))]
    rows = [
        (n, None, "app", "c", "command", command, json.dumps(doc, ensure_ascii=False, **layouts[n % 3]), n)
        for n, (command, doc) in enumerate(documents)
    ]
    events = spark.createDataFrame(rows, EVENTS)
    details = feature_details(events).select("event_key", "feature_type", "feature_name", "sample_path", "sample_value").collect()
    names = features(events).select("event_key", "feature_type", "feature_name").collect()
    return sorted(map(tuple, details)), sorted(map(tuple, names))


def assert_same(spark, documents):
    details, names = run(spark, documents)
    want = sorted((n, *f) for n, (command, doc) in enumerate(documents) for f in expected(command, doc))
    assert details == want
    assert names == sorted(f[:3] for f in want)


KEYS = st.sampled_from(["a", "b.c", "$gt", "$expr", "$and", "$match", "$weird key", "q", "é", 'quo"te', "$esc\\ape", '$q"x', "pipeline", "$lookup"])
LEAVES = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 10**12), st.sampled_from(["", "$a", '{"$x":1}', '"$y":', "a\\", "line\nbreak", "[1]", "$lookup", "$$v"])
)
VALUES = st.recursive(LEAVES, lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(KEYS, inner, max_size=3)), max_leaves=12)
BODIES = st.dictionaries(KEYS, VALUES, max_size=3)


def stage_lists():
    plain = st.builds(lambda name, body: {name: body}, st.sampled_from(["$match", "$project", "$group", "$unionWith", "other", "$unset"]), VALUES)
    odd = st.sampled_from([{}, 1, "text", None, {"$match": {"$a": 1}, "$limit": {"$b": 2}}, {"$facet": [{"$c": 1}]}, {"$lookup": "x"}])
    base = st.lists(st.one_of(plain, odd), max_size=3)

    def nest(inner):
        lookup = st.builds(lambda p, extra: {"$lookup": {"from": "x", "pipeline": p, "let": extra}}, inner, VALUES)
        facet = st.builds(lambda p, q, r: {"$facet": {"one": p, "$two": q, "three": r}}, inner, inner, LEAVES)
        return st.lists(st.one_of(plain, lookup, facet), max_size=3)

    return st.recursive(base, nest, max_leaves=4)


COMMANDS = st.one_of(
    st.builds(lambda f, p: ("find", {"find": "c", "filter": f, "projection": p}), BODIES, VALUES),
    st.builds(lambda f: ("find", {"filter": f}), BODIES),
    st.builds(lambda q, u: ("findAndModify", {"findAndModify": "c", "query": q, "update": u}), BODIES, BODIES),
    st.builds(lambda items: ("update", {"update": "c", "updates": items}), st.lists(st.one_of(st.builds(lambda q, u: {"q": q, "u": u}, BODIES, BODIES), LEAVES), max_size=3)),
    st.builds(lambda items: ("delete", {"delete": "c", "deletes": items}), st.lists(st.builds(lambda q: {"q": q, "limit": 1}, BODIES), max_size=3)),
    st.builds(lambda p: ("aggregate", {"aggregate": "c", "pipeline": p, "cursor": {}}), stage_lists()),
    st.builds(lambda body: ("distinct", {"distinct": "c", "query": body}), BODIES),
    st.builds(lambda body: ("hello", {"hello": 1, "x": body}), BODIES),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(COMMANDS, min_size=20, max_size=60))
def test_random_documents_match_brute_force(spark, documents):
    assert_same(spark, documents)


def test_deep_documents(spark):
    deep = {"$gt": 1}
    for _ in range(60):
        deep = {"$and": [{"a": deep}]}
    pipeline = [{"$limit": 1}]
    for _ in range(8):
        pipeline = [{"$lookup": {"pipeline": pipeline}}]
    assert_same(spark, [("find", {"filter": deep}), ("aggregate", {"pipeline": pipeline})])


def test_distinct_and_count_bodies_are_not_read(spark):
    assert_same(spark, [("count", {"count": "c", "query": {"a": {"$in": [1]}}}), ("distinct", {"distinct": "c", "query": {"a": {"$gt": 0}}})])


def test_text_with_escapes_takes_the_exact_way(spark):
    doc = json.dumps({"filter": {"a": '{"$x":1}'}})
    frame = spark.createDataFrame([(doc,), ('{"filter":{"a":{"$gt":1}}}',)], "doc STRING")
    assert [r[0] for r in frame.select(needs_walk("doc")).collect()] == [True, False]


def test_sample_is_the_newest_event(spark):
    import datetime as dt

    def event(key, second, value):
        return (key, dt.datetime(2024, 1, 1, 0, 0, second) if second else None, "app", "c", "query", "find", json.dumps({"find": "c", "filter": {"z": {"$gt": value}, "a": {"$gt": value}}}), key)

    rows = usage_rollup(spark.createDataFrame([event(5, 1, 10), event(4, 9, 20), event(3, 9, 30), event(9, None, 40)], EVENTS)).collect()
    gt = next(r for r in rows if r.feature_name == "$gt")
    assert (gt.usage_count, gt.sample_path, gt.sample_value, gt.max_duration_ms) == (8, "command.filter.a.$gt", "30", 9)
    assert (gt.first_seen.second, gt.last_seen.second) == (1, 9)


def test_hot_group(spark):
    """One group with almost all rows gives the same counts as brute force."""
    template = '{"find":"c","filter":{"a":{"$gt":1},"$or":[{"b":{"$in":[1]}},{"c":{"$gt":2}}]}}'
    rows = spark.range(20_000).select(
        F.col("id").alias("event_key"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("db_name"),
        F.lit("c").alias("collection_name"),
        F.lit("query").alias("op"),
        F.lit("find").alias("command_name"),
        F.lit(template).alias("command_doc"),
        F.col("id").alias("duration_ms"),
    )
    got = {(r.feature_name, r.database): r for r in usage_rollup(rows).collect()}
    assert set(USAGE_KEYS) <= set(next(iter(got.values())).asDict())
    assert got["$gt", "hot"].usage_count == 2 * 19_800 and got["$gt", "cold"].usage_count == 400
    assert got["$or", "hot"].max_duration_ms == 19_999


def test_repeated_keys_count_once_by_either_way(spark):
    docs = ['{"find":"c","filter":{"a":{"$gt":1,"$gt":2},"b":{"$gt":3}}}', '{"find":"c","filter":{"a":{"$gt":1,"$gt":2},"b":{"$gt":3},"t":"x\\\\y"}}']
    rows = [(n, None, "app", "c", "query", "find", doc, n) for n, doc in enumerate(docs)]
    events = spark.createDataFrame(rows, EVENTS)
    found = [sorted((r.event_key, r.feature_name) for r in f(events).collect() if r.feature_type == "operator") for f in (features, feature_details)]
    assert found[0] == found[1] == [(n, "$gt") for n in (0, 0, 1, 1)]


def test_a_wide_update_is_walked_in_proportion(spark):
    def seconds(items: int) -> float:
        doc = json.dumps({"update": "c", "updates": [{"q": {"n": {"$eq": n}, "t": "a\\b"}, "u": {"$set": {"x": n}}} for n in range(items)]})
        events = spark.createDataFrame([(1, None, "app", "c", "command", "update", doc, 1)], EVENTS)
        start = time.perf_counter()
        assert features(events).filter("feature_type = 'operator'").count() == 2 * items
        return time.perf_counter() - start

    seconds(50)
    assert seconds(8000) < 6 * max(seconds(2000), 0.5)


def test_every_group_is_rolled_up_once_for_any_key(spark):
    when = dt.datetime(2024, 1, 1)
    keys = [-(2**63), -(2**63) + 1, -(10**18), -1, 0, 1, 2**63 - 1]
    rows = [(key, when + dt.timedelta(days=n // 2), "app", f"c{n % 3}", "query", "find", json.dumps({"find": "c", "filter": {f"f{n}": {"$gt": n}}}), n) for n, key in enumerate(keys)]
    early = [(5, dt.datetime(1950, 1, 1), "old", "c", "query", "find", '{"find":"c","filter":{"a":{"$lt":1}}}', 1)]
    untimed = [(-7, None, "none", "c", "query", "find", '{"find":"c","filter":{"a":{"$in":[]}}}', 1)]
    events = spark.createDataFrame((rows + early + untimed) * 3, EVENTS)
    counted = {tuple(r[c] for c in USAGE_KEYS): r.usage_count for r in usage_counts(events).collect()}
    rolled = usage_rollup(events).collect()
    assert len(rolled) == len(counted)
    assert {tuple(r[c] for c in USAGE_KEYS): r.usage_count for r in rolled} == counted
    newest = {r.collection: r.sample_path for r in rolled if r.feature_name == "$gt"}
    assert newest == {"c0": "command.filter.f6.$gt", "c1": "command.filter.f4.$gt", "c2": "command.filter.f5.$gt"}
    assert all(r.sample_value is not None for r in rolled)


def test_first_level_expr_is_read_from_the_text(spark):
    docs = [
        ("find", {"filter": {"$expr": {"$gt": ["$a", {"$abs": 1}]}, "b": {"$in": [1]}}}, False),
        ("find", {"filter": {"$expr": {"$expr": {"$gt": ["$a", 1]}}}}, True),
        ("find", {"filter": {"$or": [{"$expr": {"$gt": ["$a", 1]}}]}}, True),
        ("find", {"filter": {"a": "$expr", "b": {"$gt": 1}}, "projection": {"c": {"$slice": 2}}}, True),
        ("findAndModify", {"findAndModify": "c", "query": {"$expr": {"$lt": ["$a", 1]}}, "update": {"$set": {"x": 1}}}, False),
        ("update", {"updates": [{"q": {"a": {"$gt": 1}}, "u": {"$set": {"b": 1}}}, "text", 7, None, [{"q": {"$in": 1}}], {"q": {"$ne": 1}}]}, False),
        ("delete", {"deletes": [{"q": {"a": {"$lt": 1}}}, "", [1], {"q": {"$or": []}, "limit": 1}]}, False),
    ]
    assert_same(spark, [(command, doc) for command, doc, _ in docs])
    rows = spark.createDataFrame([(n, command, json.dumps(doc)) for n, (command, doc, _) in enumerate(docs)], "n INT, command STRING, doc STRING")
    opened = rows.withColumn("parts", walk.command_parts("doc")).orderBy("n").select(F.expr(walk._deep_expr("doc", "command", "parts")))
    assert [r[0] for r in opened.collect()] == [walked for _, _, walked in docs]


def test_documents_are_counted_in_batches_or_left_open(spark):
    """Escapes, `$expr` at any depth and repeated keys need no walk; texts in place of stages and broken documents do."""
    closed = [
        ("find", {"filter": {"t": 'said "$gt": no', "$or": [{"$expr": {"$expr": {"$gt": ["$a", {"$gt": 1}]}}}, {"a": {"$in": [{"$in": 1}]}}]}, "projection": "x"}),
        ("aggregate", {"pipeline": [{"$match": {"$expr": {"$gt": 1}, "t": "a\\b"}}, {}, 7, "text", {"$lookup": {"pipeline": [{"$facet": {"a": [{"$limit": 1}], "b": 1}}]}}, {"$facet": [{"$c": 1}]}, {"$lookup": "x"}]}),
        ("update", {"updates": [{"q": {"n": {"$eq": n}}, "u": {"$set": {"é": n}}} for n in range(40)] + ["text", None]}),
        ("delete", {"deletes": {"q": {"$in": 1}}}),
        ("findAndModify", {"query": {"a": {"$lt": 1}}, "update": [{"$set": {"b": 1}}]}),
        ("insert", {"insert": "c", "documents": [{"$a": 1}]}),
        ("hello", {"hello": 1}),
    ]
    left = [
        ("find", '{"filter":{"$a":NaN}}'), ("find", '{"filter":{"$a":1}} {'), ("find", '[{"filter":{"$a":1}}]'), ("find", "text"), ("find", ""), ("find", None), ("find", r'{"filter":{"$\ud800":1}}'),
        ("aggregate", r'{"pipeline":["{\"$match\":{}}",{"$limit":1}]}'), ("aggregate", r'{"pipeline":[{"$facet":"{\"a\":[{\"$limit\":1}]}"}]}'), ("find", '{"filter":' + '{"$a":' * 200_000 + "1" + "}" * 200_001),
    ]
    rows = [(n, command, json.dumps(doc)) for n, (command, doc) in enumerate(closed)] + [(100 + n, *row) for n, row in enumerate(left)]
    rows += [(50, "find", '{"filter":{"a":{"$gt":1,"$gt":2},"a":{"$lt":1},"$or":[],"$or":[{"$in":1}]}}'), (51, None, '{"find":1}')]
    frame = spark.createDataFrame(rows, "event_key LONG, command_name STRING, command_doc STRING")
    got = {r.event_key: r.uses for r in frame.select("event_key", tally.counted_features("command_doc", "command_name").alias("uses")).collect()}
    as_counts = lambda uses: {(u.feature_type, u.feature_name): u.n for u in uses}
    for n, (command, doc) in enumerate(closed):
        assert as_counts(got[n]) == Counter(f[:2] for f in expected(command, doc)), (command, doc)
    assert as_counts(got[50]) == {("command", "find"): 1, ("operator", "$lt"): 1, ("operator", "$or"): 1, ("operator", "$in"): 1}
    assert got[51] == [] and [got[100 + n] for n in range(len(left))] == [None] * len(left)

    native = frame.filter("event_key < 109").withColumn("parts", walk.command_parts("command_doc")).select("event_key", F.explode(walk.feature_names("command_doc", "command_name", "parts")).alias("f"))
    events = frame.filter("event_key < 109").selectExpr("*", "CAST(NULL AS TIMESTAMP_NTZ) ts", "'app' db_name", "'c' collection_name", "'command' op", "1L duration_ms")
    one_by_one = features(events).select("event_key", "feature_type", "feature_name").collect()
    assert sorted(map(tuple, one_by_one)) == sorted((r.event_key, *r.f) for r in native.collect())
    names = {key: command for key, command, _ in rows}
    assert {(r.feature_type, r.feature_name, r.command_name): r.usage_count for r in usage_counts(events).collect()} == Counter((r.feature_type, r.feature_name, names[r.event_key]) for r in one_by_one)
