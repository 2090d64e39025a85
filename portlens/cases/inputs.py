"""Input views for the registered queries, derived from the given tables.

Each entry is one SELECT that both Spark SQL and DuckDB can run, so a query
and its check SQL read the very same rows. All of them grow with their base
table; only the rule and override dimensions are fixed.
"""

from __future__ import annotations

import re


def _text(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def _doc(template: str) -> str:
    """SQL for a JSON document; `@N@` is the event amount, `@K@` its key, `@c1@` and the like picked parts. None is NULL."""
    cut = re.split(r"@(\w+)@|(\\)", template)
    # A backslash inside a literal would mean different things to the two engines.
    values = {"N": "amount", "K": "CAST(event_id AS STRING)"}
    parts = []
    for at in range(0, len(cut), 3):
        name, back = cut[at - 2 : at] if at else (None, None)
        parts += [values.get(name, name)] if name else ["chr(92)"] if back else []
        parts += [_text(cut[at])] if cut[at] or len(cut) == 1 else []
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


# A small grammar of calls to a made-up weather service: what a document holds is
# picked by the event's key, so that parts come together in many ways. Keys are
# sorted inside each value so that sample payloads read the same in both engines;
# the order of top-level keys is the order a driver sends.
_CONDITIONS = [
    '{"low":{"$lt":@N@}}', '{"name":{"$options":"m","$regex":"port$"}}', '{"sky":{"$nin":["XX","YY"]}}', '{"masts":{"$elemMatch":{"built":{"$gte":1950},"kind":{"$all":["steel"]}}}}',
    '{"height":{"$gt":3,"$ne":77}}', '{"closed":{"$exists":true}}', '{"mast":{"$not":{"$size":2}}}', '{"owner":{"$in":["navy","city"]}}', '{"at":{"$type":"date"}}', '{"peak":{"$gte":@N@,"$lte":900}}',
    '{"$nor":[{"kind":"buoy"},{"high":{"$mod":[4,0]}}]}', '{"plain":@N@}', '{"where":{"$geoWithin":{"$box":[[0,0],[@N@,9]]}}}',
]
_VALUES = [
    '{"$avg":["$low","$high"]}', '{"$cond":[{"$gt":["$peak",@N@]},"storm","calm"]}', '{"$toUpper":"$name"}', '{"$switch":{"branches":[{"case":{"$lt":["$low",0]},"then":{"$abs":"$low"}}],"default":0}}',
    '{"$map":{"as":"p","in":{"$substrCP":["$$p",0,2]},"input":"$parts"}}', '{"$regexMatch":{"input":"$name","regex":"bay"}}', '{"$setField":{"field":"t","input":{"k":"$kind"},"value":"$owner"}}',
    '{"$reduce":{"in":{"$add":["$$value","$$this.km"]},"initialValue":0,"input":"$up"}}', '{"$isoWeek":"$at"}', '"$low"', '{"$divide":["$high",{"$max":[@N@,1]}]}',
]
_STEPS = [
    '{"$match":@c1@}', '{"$set":{"feel":@v1@}}', '{"$group":{"_id":"$day","worst":@v2@}}', '{"$unwind":"$days"}', '{"$sort":{"top":-1}}', '{"$limit":9}', '{"$project":{"a":@v2@,"b":1}}', '{"$addFields":{"week":@v1@}}',
    '{"$bucketAuto":{"buckets":7,"groupBy":"$high"}}', '{"$graphLookup":{"as":"up","connectFromField":"into","connectToField":"_id","from":"rivers","startWith":"$into"}}', '{"$count":"n"}', '{"$unset":"marks"}',
    '{"$match":{"$and":[@c2@,@c1@]}}', '{"$sample":{"size":2}}', '{"$replaceRoot":{"newRoot":"$site"}}',
]
_NESTS = [
    '{"$lookup":{"as":"site","foreignField":"_id","from":"stations","localField":"station","pipeline":[@s3@,{"$facet":{"far":[@s1@,{"$skip":4}],"near":[{"$limit":6}]}}]}}',
    '{"$facet":{"days":[@s1@,{"$sort":{"top":-1}}],"total":[{"$match":{"low":{"$lte":30}}},{"$count":"n"}]}}',
    '{"$lookup":{"as":"a","from":"x","pipeline":[{"$lookup":{"as":"b","from":"y","pipeline":[{"$match":{"v":{"$gt":@N@}}},@s3@]}}]}}',
    '{"$unionWith":{"coll":"squalls","pipeline":[{"$match":{"peak":{"$gt":60}}}]}}', '{}', '"loose"', '{"bare":{"$floor":2}}', '{"$redact":{"$cond":[true,"$$KEEP","$$PRUNE"]}}', '{"$lookup":"broken"}',
]
_ENDS = ['{"$out":"all_gusts"}', '{"$merge":{"into":"worst_days","on":"_id"}}', '{"$limit":5}', '{"$count":"n"}', '{"$match":{"low":{"$lte":30}}}', '{"$sort":{"x":1}}']
_CHANGES = [
    '{"$inc":{"checks":1}}', '{"$push":{"log":"old"},"$set":{"state":"aged"}}', '{"$currentDate":{"seen":true},"$max":{"age":12}}', '{"$rename":{"maker":"brand"}}', '{"$pull":{"log":{"kind":{"$in":["noise"]}}}}',
    '{"$min":{"age":5},"$unset":{"spare":""}}', '{"whole":"document"}', '{"$addToSet":{"tags":{"$each":["a","b"]}}}', '{"$mul":{"gain":@N@}}',
]

# The parts of an event's document: name, list, and how the key picks from it. Later ones hold earlier ones.
_GRAMMAR = [
    [("c1", _CONDITIONS, "event_id * 5"), ("c2", _CONDITIONS, "event_id * 7 + 3"), ("c3", _CONDITIONS, "event_id + 8"), ("v1", _VALUES, "event_id * 3 + 1"), ("v2", _VALUES, "event_id * 9 + 4"), ("u1", _CHANGES, "event_id * 2"), ("u2", _CHANGES, "event_id * 5 + 3")],
    [("s1", _STEPS, "event_id * 7"), ("s2", _STEPS, "event_id * 11 + 2"), ("s3", _STEPS, "event_id * 2 + 5")],
    [("n1", _NESTS, "event_id * 4 + 1"), ("e1", _ENDS, "event_id * 5 + 2")],
]

# Wide documents: many objects that hold the same keys.
_WIDE = ",".join(f'{{"q":{{"slot":{{"$eq":{n}}}}},"u":{{"$mul":{{"gain":{n}}}}}}}' for n in range(40))
# (operation, command, query, updateobj) of each kind of call.
WORKLOAD = [
    ("query", '{"find":"stations","filter":{"$or":[@c1@,@c2@]},"projection":{"name":1,"parts":{"$slice":-3}},"lsid":{"id":"w1"},"$db":"weather"}', None, None),
    ("command", '{"aggregate":"gusts","pipeline":[@s1@,@s2@],"cursor":{}}', None, None),
    ("query", '{"find":"gusts","filter":@c3@,"limit":@N@}', None, None),
    ("command", '{"aggregate":"readings","pipeline":[@s2@,@n1@,@e1@],"cursor":{}}', None, None),
    ("update", '{"q":@c2@,"u":@u1@,"multi":false}', None, None),
    ("command", '{"update":"sensors","updates":[{"multi":true,"q":@c1@,"u":@u1@},{"q":@c3@,"u":@u2@},"not an object"],"ordered":true}', None, None),
    ("command", '{"count":"gusts","query":@c1@}', None, None),
    ("command", '{"aggregate":"stations","pipeline":[@s3@],"cursor":{}}', None, None),
    ("command", '{"delete":"gusts","deletes":[{"limit":0,"q":@c2@}],"ordered":true}', None, None),
    ("getmore", '{"getMore":@K@,"collection":"readings"}', None, None),
    ("query", '{"find":"readings","filter":{"$expr":{"$lt":[@v1@,{"$multiply":["$high",@v2@]}]}},"projection":{"low":1}}', None, None),
    ("command", '{"findAndModify":"sensors","query":@c1@,"update":@u2@,"new":false}', None, None),
    ("command", '{"aggregate":"rivers","pipeline":[@s1@,@s3@,@n1@,@s2@,@e1@],"cursor":{}}', None, None),
    ("query", None, "@c2@", None),
    ("command", '{"insert":"gusts","documents":[{"_id":@K@,"peak":@N@,"path":[{"lat":1,"lon":2}],"marks":[]}],"ordered":false}', None, None),
    ("query", '{"find":"notes","filter":{"text":{"$ne":"said \\"$gt\\": twice"},"value":{"$lt":@N@}},"projection":{"text":1}}', None, None),
    ("command", '{"distinct":"readings","key":"sky","query":@c3@}', None, None),
    ("command", '{"update":"sensors","updates":[' + _WIDE + '],"ordered":false}', None, None),
    ("command", '{"aggregate":"gusts","pipeline":[@s2@,@s1@,@e1@],"cursor":{}}', None, None),
    ("update", None, '{"_id":@K@}', "@u1@"),
    ("command", '{"createIndexes":"stations","indexes":[{"key":{"country":1},"name":"by_country"}]}', None, None),
    ("remove", "{}", "@c1@", None),
    ("command", '{"listIndexes":"stations"}', None, None),
    ("command", '{"dropIndexes":"stations","index":"by_country"}', None, None),
    ("command", '{"lsid":{"id":"w2"},"$clusterTime":3,"hello":1,"comment":"check"}', None, None),
    ("insert", "", None, None),
    ("command", '{"$db":"weather","lsid":{"id":"w3"}}', None, None),
    ("query", '{"find":"system.profile","filter":{"ts":{"$gte":5}}}', None, None),
]


def _picked(source: str, level: list[tuple[str, list[str], str]]) -> str:
    """SQL for a source with one more level of parts."""
    arms = lambda values: " ".join(f"WHEN {n} THEN {_doc(v)}" for n, v in enumerate(values))
    return "SELECT *, " + ", ".join(f"CASE ({key}) % {len(values)} {arms(values)} END AS {name}" for name, values, key in level) + f" FROM {source}"


def _choose(column: int) -> str:
    arms = []
    for number, entry in enumerate(WORKLOAD):
        value = entry[column]
        arms.append(f"WHEN {number} THEN {'NULL' if value is None else _doc(value)}")
    return f"CASE event_id % {len(WORKLOAD)} " + " ".join(arms) + " END"


_SELF_READ = len(WORKLOAD) - 1
_NO_NAMESPACE = len(WORKLOAD) - 4
_DEALT = "(SELECT *, CAST(CAST(floor(value) AS BIGINT) AS STRING) AS amount FROM events) e0"
for _number, _level in enumerate(_GRAMMAR, 1):
    _DEALT = f"({_picked(_DEALT, _level)}) e{_number}"

PROFILE = f"""
SELECT event_id AS event_key, ts,
  CASE WHEN event_id % {len(WORKLOAD)} = {_SELF_READ} THEN 'app_' || CAST(user_id % 3 AS STRING) || '.system.profile'
       WHEN event_id % {len(WORKLOAD)} = {_NO_NAMESPACE} THEN 'plain'
       ELSE 'app_' || CAST(user_id % 3 AS STRING) || '.' || event_type || CASE WHEN user_id % 5 = 0 THEN '.part' ELSE '' END
  END AS ns,
  'db_' || event_type AS db,
  {_choose(0)} AS op,
  {_choose(1)} AS command,
  {_choose(2)} AS query,
  {_choose(3)} AS updateobj,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 4) AS BIGINT) END AS millis,
  CAST(floor(value) AS BIGINT) AS nreturned,
  CAST(floor(value * 3) AS BIGINT) AS docsExamined,
  CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value * 2) AS BIGINT) END AS keysExamined,
  CASE WHEN event_type = 'error' THEN CAST(event_id % 100 AS BIGINT) END AS errCode,
  CASE WHEN event_type = 'error' THEN 'failed ' || CAST(event_id % 100 AS STRING) WHEN event_type = 'click' THEN '' END AS errMsg
FROM {_DEALT}
"""

# Documents whose keys occur again, in one object or across objects, with the
# features that a reader who keeps the last of a repeated key finds:
# (command, document, features).
SHAPES = [
    ("find", '{"find":"c","filter":{"a":{"$gt":1,"$gt":@N@},"b":{"$gt":2}}}', ["operator $gt", "operator $gt"]),
    ("find", '{"find":"c","filter":{"a":{"$gt":1},"b":{"$gt":2},"d":{"$gt":@N@}}}', ["operator $gt"] * 3),
    ("find", '{"find":"c","filter":{"a":{"$gt":1},"a":{"$lt":@N@}}}', ["operator $lt"]),
    ("find", '{"find":"c","filter":{"$or":[{"a":{"$in":[1]}}],"$or":[{"a":{"$nin":[{"$or":@N@}]}}]}}', ["operator $or", "operator $nin", "operator $or"]),
    ("find", '{"find":"c","filter":{"$and":[{"$and":[{"$and":[{"x":@N@}]}]}]}}', ["operator $and"] * 3),
    ("find", '{"find":"c", "filter" : {"a":{"$ne" :1, "$ne" :2 ,"$eq":{"$ne":@N@}}}}', ["operator $ne", "operator $eq", "operator $ne"]),
    ("aggregate", '{"aggregate":"c","pipeline":[{"$match":{"a":{"$gt":1}}},{"$match":{"a":{"$gt":@N@}}}]}', ["stage $match", "operator $gt"] * 2),
    ("aggregate", '{"aggregate":"c","pipeline":[{"$match":{"a":{"$gt":1,"$gt":2}}},{"$limit":@N@}]}', ["stage $match", "operator $gt", "stage $limit"]),
    ("aggregate", '{"aggregate":"c","pipeline":[{"$set":{"x":{"$add":[{"$add":[1,2]},{"$add":[@N@]}]}}}]}', ["stage $set"] + ["expression $add"] * 3),
    ("aggregate", '{"aggregate":"c","pipeline":[{"$lookup":{"from":"d","pipeline":[{"$lookup":{"from":"e","pipeline":[{"$lookup":{"from":"f","pipeline":[{"$lookup":{"pipeline":[{"$limit":@N@}]}}]}}]}}]}}]}', ["stage $lookup"] * 4 + ["stage $limit"]),
    ("aggregate", '{"aggregate":"c","pipeline":[{"$facet":{"a":[{"$count":"n"}],"a":[{"$limit":1},{"$skip":@N@}]}}]}', ["stage $facet", "stage $limit", "stage $skip"]),
    ("update", '{"update":"c","updates":[{"q":{"a":{"$gt":1}},"u":{"$set":{"b":1},"$set":{"b":@N@}}},{"q":{"a":{"$gt":1}},"u":{"$set":{"b":1}}}]}', ["operator $gt", "operator $set"] * 2),
    ("delete", '{"delete":"c","deletes":[{"q":{"a":{"$lt":1}}},{"q":{"a":{"$lt":@N@}}}]}', ["operator $lt"] * 2),
    ("findAndModify", '{"findAndModify":"c","query":{"a":{"$in":[1],"$in":[@N@]}},"update":{"$inc":{"a":1}}}', ["operator $in", "operator $inc"]),
    ("aggregate", '{"aggregate":"c","pipeline":[{"$match":{"$expr":{"$gt":["$a",{"$abs":@N@}]}}},{"$match":{"t":"said \\"$lt\\": no"}}]}', ["stage $match", "operator $expr", "expression $gt", "expression $abs", "stage $match"]),
]
SHAPE_EVENTS = (
    f"SELECT event_id AS event_key, ts, 'app' AS db_name, 'c' AS collection_name, 'command' AS op, CAST(floor(value) AS BIGINT) AS duration_ms, CASE event_id % {len(SHAPES)} "
    + " ".join(f"WHEN {n} THEN '{command}'" for n, (command, _, _) in enumerate(SHAPES))
    + f" END AS command_name, CASE event_id % {len(SHAPES)} "
    + " ".join(f"WHEN {n} THEN {_doc(document)}" for n, (_, document, _) in enumerate(SHAPES))
    + " END AS command_doc FROM (SELECT *, CAST(CAST(floor(value) AS BIGINT) AS STRING) AS amount FROM events) e"
)

# Exported profiler lines: whole records, cut ones, other text, blanks.
PROFILE_LINES = """
SELECT event_id AS line_no, CASE event_id % 9
  WHEN 5 THEN '{"ns":"app_1.cut","op":"que'
  WHEN 6 THEN 'starting ' || event_type || ' at ' || CAST(event_id AS STRING)
  WHEN 7 THEN CASE WHEN event_id % 2 = 0 THEN '  ' ELSE '[{"ns":"app_1.list"}]' END
  WHEN 8 THEN '{"ns":"app_1.two","op":"query"} trailing {'
  ELSE '{"ts":{"$date":"2024-01-0' || CAST(1 + event_id % 9 AS STRING) || 'T05:06:07"},"ns":"app_' || CAST(user_id % 3 AS STRING) || '.' || event_type || '","op":"query",'
    || '"command":{"find":"c","filter":{"a":{"$gt":' || CAST(event_id AS STRING) || '}}},"millis":' || CAST(CAST(floor(value) AS BIGINT) AS STRING) || '}'
END AS line FROM events
"""

# Server log lines: candidates, other components, broken JSON, odd shapes.
LOG_LINES = """
SELECT event_id AS line_no, CASE event_id % 10
  WHEN 0 THEN '{"t":{"$date":"' || seen || '"},"c":"COMMAND","msg":"Slow query","attr":{"ns":"' || ns || '","command":{"find":"c","filter":{"a":' || amount || '},"$db":"x"}}}'
  WHEN 1 THEN '{"t":{"$date":"' || seen || '"},"c" : "COMMAND","attr":{"ns":"' || ns || '","command":{"lsid":{"id":1},"$db":"x","aggregate":"c"}}}'
  WHEN 2 THEN '{"t":{"$date":"' || seen || '"},"c":"WRITE","msg":"Slow query","attr":{"ns":"' || ns || '.deep","command":{"q":{"a":1}}}}'
  WHEN 3 THEN '{"t":{"$date":"' || seen || '"},"c":"NETWORK","attr":{"ns":"' || ns || '","command":{"find":"c"}}}'
  WHEN 4 THEN '{"t":{"$date":"' || seen || '"},"c":"COMMAND","attr":{"ns":"' || ns || '","command":{"find":"c"}'
  WHEN 5 THEN '{"t":{"$date":"' || seen || '"},"c":"COMMAND","attr":"' || ns || '"}'
  WHEN 6 THEN '{"9x":1,"t":{"$date":"' || seen || '"},"c":"COMMAND","attr":{"ns":"' || ns || '","command":{"$db":"x","lsid":{}}}}'
  WHEN 7 THEN '{"c":"COMMAND","attr":{"ns":"' || ns || '","type":"' || event_type || '"}}'
  WHEN 8 THEN '{"t":{"$date":"' || seen || '"},"c":"COMMAND","attr":{"ns":"admin.' || event_type || '","command":{"ping":1}}}'
  ELSE 'plain text about ' || ns || ' Slow query'
END AS line
FROM (SELECT event_id, event_type, CAST(CAST(floor(value) AS BIGINT) AS STRING) AS amount,
  'app_' || CAST(user_id % 3 AS STRING) || '.' || event_type AS ns,
  '2024-01-' || CAST(10 + event_id % 20 AS STRING) || 'T00:00:00.000+00:00' AS seen FROM events) e
"""

# Counter documents, one per instance.
COUNTERS = """
SELECT instance, '{"commands":{"<UNKNOWN>":' || n || ',"find":{"failed":' || errors || ',"total":' || n || '},"Hello":{"failed":0,"total":' || n
  || '},"aggregate":{"failed":2.0,"ok":' || clicks || ',"on":true},"idle":0,"flag":true,"note":"' || n || '","odd":{"total":true,"x":3},"ping":7.9,"words":{"a":"1"}},'
  || '"aggStageCounters":{"$match":' || n || ',"$group":{"total":' || clicks || ',"$inner":{"$deep":' || errors || '}},"$none":0,"other":{"$sort":' || views || '},"list":[{"$hidden":1}]},'
  || '"operatorCounters":{"expressions":{"$add":' || clicks || ',"$abs":0},"match":{"$eq":' || n || ',"$in":{"total":' || views || '}}}}' AS metrics
FROM (SELECT 'node_' || CAST(user_id AS STRING) AS instance, CAST(count(*) AS STRING) AS n,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS STRING) AS errors,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS STRING) AS clicks,
  CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS STRING) AS views
  FROM events GROUP BY user_id) c
"""

# Inventory documents, one per instance.
INVENTORY = """
SELECT c_name AS instance, '{"hello":' || CASE c_custkey % 4 WHEN 0 THEN '{"msg":"isdbgrid","maxWireVersion":21}'
    WHEN 1 THEN '{"setName":"rs' || CAST(c_nationkey AS STRING) || '","isWritablePrimary":true,"hosts":["h1","h2"]}'
    WHEN 2 THEN '{"isWritablePrimary":true,"secondary":false}' ELSE '{}' END
  || ',"buildInfo":{"version":"' || CAST(4 + c_nationkey % 4 AS STRING) || '.0","gitVersion":"g' || CAST(c_custkey AS STRING) || '","modules":["m1","m2"],"allocator":"tc"}'
  || ',"hostInfo":{"system":{"hostname":"host' || CAST(c_custkey AS STRING) || '","numCores":' || CAST(2 + c_nationkey AS STRING) || ',"memSizeMB":1024,"cpuArch":"x86","os":{"name":"Linux","version":"8"}}}'
  || ',"getDefaultRWConcern":{"defaultReadConcern":{"level":"local"}}'
  || ',"serverStatus":{"uptime":' || CAST(c_custkey AS STRING) || ',"connections":{"current":5,"available":95},"mem":{"resident":64},"storageEngine":{"name":"wt"},"metrics":{"commands":{"find":1,"ping":2},"operatorCounters":{"x":{}}}}'
  || ',"listDatabases":{"databases":[{"name":"admin","sizeOnDisk":10,"empty":false},{"name":"app_' || CAST(c_custkey % 3 AS STRING) || '","sizeOnDisk":' || CAST(c_custkey * 10 AS STRING) || '},{"name":" ","sizeOnDisk":1},{"name":"Local","empty":true}]}'
  || ',"getShardMap":' || CASE c_custkey % 4 WHEN 0 THEN '{"map":{"shardB":"b","shardA":"a","config":"c"}}' WHEN 1 THEN '{"hosts":{"h2":"x","h1":"y"}}' ELSE '{}' END
  || ',"errors":' || CASE WHEN c_custkey % 5 = 0 THEN '{"hostInfo":"denied","getShardMap":"no"}' ELSE '{}' END || '}' AS document
FROM customer
"""

# Names that support rows, catalogue entries and rules speak about.
_NAMES = [
    ("command", "find"), ("command", "Aggregate"), ("command", "insert"), ("command", "update"), ("command", "findAndModify"),
    ("command", "distinct"), ("command", "count"), ("command", "createIndexes"), ("command", "listDatabases"), ("command", "mapReduce"),
    ("stage", "$match"), ("stage", "$project"), ("stage", "$group"), ("stage", "$Lookup"), ("stage", "$graphLookup"), ("stage", "$facet"),
    ("stage", "$out"), ("stage", "$set"), ("stage", "$bucketAuto"),
    ("operator", "$gt"), ("operator", "$in"), ("operator", "$regex"), ("operator", "$elemMatch"), ("operator", "$inc"), ("operator", "$push"),
    ("operator", "$rename"), ("operator", "$cond"), ("operator", "$map"), ("operator", "$setField"), ("operator", "$regexMatch"), ("operator", "$expr"),
]
_SINCE = [
    "19c", "26ai", "26ai. No-op (19c)", "No-op", "Not supported", "Always", "Partially supported 19c", "", "N/A", "21 c, 23AI",
    "Yes (no-op in 23ai)", "limited", "26ai (19c)", "unsupported 19c", "not applicable",
]
_SECTIONS = ["Query and Write Operation", "Aggregation Pipeline Stages", "Update Operators", "Projection Operators", "Administration", ""]


def _name_of(kind: str, key: str = "p_partkey") -> str:
    arms = " ".join(f"WHEN {n} THEN {_text(name)}" for n, (k, name) in enumerate(_NAMES) if k == kind)
    sign = "'$'" if kind != "command" else "''"
    rest = {"command": 0, "stage": 1, "operator": 2}[kind]
    return (
        f"CASE {key} % 40 {arms} ELSE CASE WHEN {key} % 40 >= {len(_NAMES)} AND {key} % 3 = {rest} "
        f"THEN {sign} || replace(p_name, ' ', '_') || '_' || CAST({key} % 97 AS STRING) ELSE '' END END"
    )


def _pick(values: list[str], key: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {n} THEN {_text(v)}" for n, v in enumerate(values)) + " END"


# The target's support table: repeated names, mixed case, blanks.
SUPPORT = f"""
SELECT row_id, 1 + row_id % 6 AS table_index, section, command, stage, operator, support_since, normalized_status, p_brand
FROM (SELECT p_partkey AS row_id, p_brand,
  {_pick(_SECTIONS, "p_size")} AS section,
  {_name_of("command")} AS command,
  {_name_of("stage")} AS stage,
  CASE WHEN p_partkey % 50 = 0 THEN '$extra' ELSE {_name_of("operator")} END AS operator,
  {_pick(_SINCE, "(p_partkey + p_size)")} AS support_since,
  CASE WHEN p_partkey % 7 = 0 THEN 'Other' WHEN p_partkey % 7 = 1 THEN '' ELSE 'Supported' END AS normalized_status
  FROM part) s
"""

# The reference catalogue, before and after an update.
CATALOG = f"""
SELECT ordinal, entity_type, source_group, category, name, short_description, doc_url, source_page_url, source_label, '2024-01-01' AS last_synced_at
FROM (SELECT p_partkey AS ordinal, p_name,
  CASE p_partkey % 5 WHEN 0 THEN 'command' WHEN 1 THEN 'stage' ELSE 'operator' END AS entity_type,
  CASE p_partkey % 5 WHEN 0 THEN 'command' WHEN 1 THEN 'aggregation_stage' WHEN 2 THEN 'query_operator' WHEN 3 THEN 'update_operator' ELSE 'expression_operator' END AS source_group,
  p_type || ' ' || CAST(p_size % 4 AS STRING) AS category,
  CASE p_partkey % 5 WHEN 0 THEN {_pick([n for k, n in _NAMES if k == "command"], "p_size")}
    WHEN 1 THEN {_pick([n for k, n in _NAMES if k == "stage"], "p_size")}
    WHEN 4 THEN '$' || replace(p_name, ' ', '_')
    ELSE {_pick([n for k, n in _NAMES if k == "operator"], "p_size")} END AS name,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'About ' || p_name || CASE WHEN p_partkey % 8 = 0 THEN '  twice' ELSE '' END END AS short_description,
  'http://docs.example.org/' || p_brand || '/' || CAST(p_partkey AS STRING) AS doc_url,
  'http://docs.example.org/' || p_type AS source_page_url,
  'Part ' || p_type AS source_label
  FROM part) c
"""

# Supplemental feature lists, one JSON object per document.
SUPPLEMENTAL = f"""
SELECT 'list_' || CAST(s_suppkey AS STRING) AS source_ref,
  '{{"$feat' || CAST(s_suppkey AS STRING) || '":{{"doc_categories":[{{"category_level_0":"Aggregation Stages","category_level_1":"' || s_name || '"}},{{"category_level_0":"","category_level_1":" "}}],"target_details":{{"notes":"None"}},"ignore":false}},'
  || '"$op' || CAST(s_suppkey AS STRING) || '":{{"doc_categories":[{{"category_level_0":"' || CASE s_suppkey % 4 WHEN 0 THEN 'Update Operators' WHEN 1 THEN 'Query and Projection Operators' WHEN 2 THEN 'Query Predicates' ELSE 'Misc' END || '","category_level_1":"n"}}],"target_details":{{"notes":"see ' || s_name || '"}}}},'
  || '"cmd' || CAST(s_suppkey AS STRING) || '":{{"ignore":true}},"Upper' || CAST(s_suppkey AS STRING) || '":{{}},"two words":{{}},"bare":1}}' AS document
FROM supplier
"""

# Customer overrides: a fixed dimension, with repeated and disabled rows.
OVERRIDES = [
    ("operator", "$regex", "", "High", "first reason", "", "true"),
    ("Operator", "$REGEX ", "", "Low", "checked with the team", "direct_use", "yes"),
    ("command", "listIndexes", "application_api", "", "", "verify_semantics", "1"),
    ("stage", "$merge", "ignore", "Ignore", "job moves elsewhere", "exclude_from_scope", "true"),
    ("stage", "$group", "", "Blocker", "off", "", "false"),
    ("expression", "$cond", "likely_admin", "", "", "", "TRUE"),
]

# Documentation pages with support tables, one per customer; a cell holds a table of its own.
SUPPORT_PAGES = """
SELECT c_custkey AS page_id, 'http://docs.example.org/p/' || CAST(c_custkey AS STRING) || '/index.html' AS url,
  '<html><body><h1>Guide &amp; ' || c_name || '</h1><table><tr><td>no</td></tr></table>'
  || CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '<h2 id="a">' || c_mktsegment || '</h2>' END
  || '<table class="x"><tr><th>Command</th><th> support
 Since </th><th>Note</th><th>Note</th></tr><tr><td><b>find</b></td><td>19c</td><td>n&nbsp;<table><tr><th>Support level</th></tr><tr><td>full</td></tr></table>' || CAST(c_nationkey AS STRING) || '</td></tr><tr></tr>'
  || '<tr><td>cmd' || CAST(c_custkey % 13 AS STRING) || '</td><td>' || CASE WHEN c_custkey % 2 = 0 THEN 'Not supported' ELSE '26ai' END || '</td><td>a</td><td>b</td><td>extra</td></tr><tr><td></td><td> </td></tr></table>'
  || '<h3>Deep</h3><table><tr><th>OPERATOR</th><th>Support</th></tr><tr><td>$op' || CAST(c_custkey % 7 AS STRING) || '</td><td>yes</td></tr></table>'
  || '<table><tr><th>stage</th><th>Support (Since)</th></tr></table></body></html>' AS html
FROM customer
"""

# Documentation pages with reference tables, one per customer.
REFERENCE_PAGES = """
SELECT c_custkey AS page_id, 'http://docs.example.org/ref/' || c_mktsegment || '/page.html' AS url,
  CASE c_custkey % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'stage' ELSE 'operator' END AS entity_type,
  CASE c_custkey % 3 WHEN 0 THEN 'command' WHEN 1 THEN 'aggregation_stage' ELSE 'query_operator' END AS source_group,
  'Label ' || c_mktsegment AS source_label,
  '<body>' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '<h4>Group ' || CAST(c_nationkey AS STRING) || '</h4>' END
  || '<table><thead><tr><th>Name</th><th>Description</th></tr></thead><tbody><tr><td><a href="../' || c_mktsegment || '.html">n' || CAST(c_custkey % 17 AS STRING) || '</a></td><td>Does ' || c_name || CASE WHEN c_custkey % 5 = 0 THEN '<table><tr><th>Name</th><th>Description</th></tr><tr><td>inner</td><td>nested <i>text</i></td></tr></table>' ELSE '' END || '</td></tr>'
  || '<tr><td><a class="k" href="#x">m' || CAST(c_custkey % 5 AS STRING) || '</a></td><td>Text</td></tr><tr><td>plain</td><td>No link</td></tr><tr><td>short</td></tr><tr><td></td><td>nameless</td></tr></tbody></table>'
  || '<table><tr><th>Other</th></tr><tr><td>x</td></tr></table></body>' AS html
FROM customer
"""

# Given pages with a version line added; the earlier snapshot lags behind.
VERSIONED_PAGES = """
SELECT page_id, url, html || CASE WHEN page_id % 4 = 3 THEN '' ELSE '<footer><p>Release 1.' || CAST(page_id % 10 AS STRING) || '</p><p>F' || CAST(10000 + page_id AS STRING) || '-0' || CAST(page_id % 3 AS STRING)
  || ' March ' || CAST(2020 + page_id % 5 AS STRING) || '</p><p>This page reflects version 8.' || CAST(page_id % 3 AS STRING) || ' of Example</p></footer>' END AS html FROM pages
"""
