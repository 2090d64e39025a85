from __future__ import annotations

import json

import pytest

from portlens.operators.events import event_table, normalize_events

SCHEMA = (
    "event_key LONG, ts TIMESTAMP_NTZ, ns STRING, db STRING, op STRING, command STRING, query STRING, updateobj STRING, "
    "millis STRING, nreturned LONG, docsExamined DOUBLE, keysExamined STRING, errCode STRING, errMsg STRING"
)


def record(**fields):
    base = dict(event_key=1, ts=None, ns="app.c", db="spare", op="command", command=None, query=None, updateobj=None)
    base |= dict(millis=None, nreturned=None, docsExamined=None, keysExamined=None, errCode=None, errMsg=None)
    return tuple((base | fields).values())


def one(spark, legacy=False, **fields):
    return normalize_events(spark.createDataFrame([record(**fields)], SCHEMA), legacy).first()


@pytest.mark.parametrize(
    "ns, db, collection",
    [("app.c", "app", "c"), ("app.c.d", "app", "c.d"), ("plain", "spare", ""), ("", "spare", ""), (None, "spare", ""), (".c", "spare", "c")],
)
def test_namespace(spark, ns, db, collection):
    row = one(spark, ns=ns)
    assert (row.db_name, row.collection_name) == (db, collection)


@pytest.mark.parametrize(
    "fields, name, doc",
    [
        (dict(command='{"find":"c"}'), "find", {"find": "c"}),
        (dict(op="query", query='{"a":1}'), "find", {"find": "c", "filter": {"a": 1}}),
        (dict(op="query", command="{}", query='{"count":"c"}'), "count", {"count": "c"}),
        (dict(op="query"), "find", {"find": "c", "filter": {}}),
        (dict(op="update", query='{"a":1}', updateobj='{"$set":{}}'), "update", {"update": "c", "updates": [{"q": {"a": 1}, "u": {"$set": {}}}]}),
        (dict(op="remove", query="[1]"), "delete", {"delete": "c", "deletes": [{"q": {}}]}),
        (dict(op="insert"), "insert", {"insert": "c"}),
        (dict(op="command", query='{"ping":1}'), "ping", {"ping": 1}),
        (dict(op="command", updateobj='{"top":1}'), "top", {"top": 1}),
        (dict(op="command"), "unknown", {}),
        (dict(op="getmore", command='{"lsid":1,"$db":"x","comment":"y"}'), "unknown", {"lsid": 1, "$db": "x", "comment": "y"}),
        (dict(op="remove", command='{"lsid":1}'), "delete", {"lsid": 1}),
    ],
)
def test_document_and_command(spark, fields, name, doc):
    row = one(spark, **fields)
    assert row.command_name == name
    assert json.loads(row.command_doc) == doc


def test_find_and_modify_is_not_an_update(spark):
    command = '{"findAndModify":"c","query":{},"update":{"$set":{"a":1}}}'
    assert one(spark, command=command).command_name == "findAndModify"
    assert one(spark, legacy=True, command=command).command_name == "update"


def test_bare_update_is_wrapped(spark):
    command = '{"q":{"a":{"$gt":1}},"u":{"$inc":{"n":1}}}'
    row = one(spark, op="update", command=command)
    assert row.command_name == "update" and json.loads(row.command_doc)["updates"][0] == json.loads(command)
    assert one(spark, legacy=True, op="update", command=command).command_name == "q"
    assert one(spark, op="remove", command='{"q":{}}').command_name == "delete"


def test_collection_name_is_quoted(spark):
    row = one(spark, op="insert", ns='app.a"b\\c')
    assert json.loads(row.command_doc) == {"insert": 'a"b\\c'}


def test_numbers_and_text(spark):
    row = one(spark, millis="12", docsExamined=3.9, keysExamined="x", errCode="", errMsg="")
    assert (row.duration_ms, row.docs_examined, row.keys_examined, row.err_code, row.err_msg) == (12, 3, None, None, None)
    flat = event_table(normalize_events(spark.createDataFrame([record()], SCHEMA))).first()
    assert flat.ts == "" and flat.err_msg == ""
