"""Features used by a command document.

Two ways to the same features. `feature_names` reads the `$` keys straight
from the JSON text, which is all that counting needs and costs one pass over
the text. `feature_nodes` opens the document as VARIANT and also gives the
path and value of every feature; it serves the samples, and the few documents
whose text alone cannot be trusted (see `needs_walk`).

The expressions are written as SQL text, which is one call to build.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from portlens import fixed

_FEATURES = "array<struct<feature_type string, feature_name string>>"
_STAGES = "array<struct<position int, name string, single boolean, text string>>"
_PIPELINES = "array<array<string>>"
_NODES = "array<struct<path string, key string, outer_expr boolean, in_expr boolean, node variant>>"
_FOUND = "array<struct<feature_type string, feature_name string, sample_path string, sample_value string>>"

# A key that starts with `$` and holds no escapes. The quote in front of it
# must not be escaped itself: then it would be part of a text value.
_KEY = r"""r'(?<!\\)"(\$[^"\\]*)"\s*:'"""
_START, _EXPR = '"$', '"$expr"'
_FEW_ROUNDS = 3
_WALKED_COMMANDS = "('find', 'update', 'delete', 'findAndModify', 'aggregate')"
# Fields that hold query texts, and fields that hold lists of items with such texts.
_QUERIES = {"find": ("filter", "projection"), "findAndModify": ("query", "`update`")}
_ITEMS = {"updates": ("q", "u"), "deletes": ("q",)}


def _words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _none(kind: str) -> str:
    return f"CAST(array() AS {kind})"


# --- pipeline stages ------------------------------------------------------


def _stages(pipeline: str, doc: str) -> str:
    """SQL for all stages of a pipeline and of the pipelines nested in it.

    A stage is named by its first key in document order. Positions restart in
    each nested pipeline. Nesting is at most as deep as there are stages that
    can nest, and as the document, so that many rounds visit all of it.
    """
    body = "get(map_values(from_json(g.text, 'map<string,string>')), 0)"

    def named(texts: str) -> str:
        opened = f"transform({texts}, (t, i) -> named_struct('position', i, 'keys', json_object_keys(t), 'text', t))"
        return (
            f"transform(filter({opened}, o -> size(o.keys) > 0), o -> named_struct("
            "'position', o.position, 'name', o.keys[0], 'single', size(o.keys) = 1, 'text', o.text))"
        )

    level = f"flatten(transform(s.open, p -> {named('p')}))"
    # Of branches with one name the last counts.
    branches = (
        f"transform(array(map_entries(from_json({body}, 'map<string,string>'))), m -> transform(filter(m, (e, i) -> "
        "NOT exists(slice(m, i + 2, size(m)), x -> x.key = e.key)), e -> from_json(e.value, 'array<string>')))[0]"
    )
    nested = (
        "filter(CASE g.name "
        f"WHEN '$lookup' THEN array(from_json({body}, 'pipeline array<string>').pipeline) "
        f"WHEN '$facet' THEN {branches} "
        "END, p -> p IS NOT NULL)"
    )
    below = f"flatten(transform(filter(l, g -> g.name IN ('$lookup', '$facet')), g -> coalesce({nested}, {_none(_PIPELINES)})))"
    # `l` is bound by transforming a one-element array, so a level is opened once.
    step = f"transform(array({level}), l -> named_struct('open', {below}, 'seen', concat(s.seen, l)))[0]"
    nests = f"""(contains({doc}, '"$lookup"') OR contains({doc}, '"$facet"'))"""
    # The depth matters only where many stages can nest: else their number is bound enough.
    able = rf"""size(regexp_extract_all({doc}, r'("\$(?:lookup|facet)")', 1))"""
    rounds = f"sequence(0, transform(array({able}), k -> IF(k <= {_FEW_ROUNDS}, k, least(k, {depth_sql(doc)})))[0])"
    start = f"named_struct('open', CAST(array({pipeline}) AS {_PIPELINES}), 'seen', {_none(_STAGES)})"
    nested_too = f"aggregate({rounds}, {start}, (s, r) -> {step}, s -> s.seen)"
    return f"CASE WHEN {pipeline} IS NULL THEN {_none(_STAGES)} WHEN {nests} THEN {nested_too} ELSE {named(pipeline)} END"


# --- names from the text --------------------------------------------------


def _keys(text: str) -> str:
    return f"coalesce(regexp_extract_all({text}, {_KEY}, 1), {_none('array<string>')})"


def _typed(kind: str, names: str) -> str:
    return f"transform({names}, n -> named_struct('feature_type', {kind}, 'feature_name', n))"


def _stage_names() -> str:
    """SQL for the features of stage `g`.

    The bodies of lookups and facets are covered by their nested pipelines.
    """
    body = "from_json(g.text, 'map<string,string>')[g.name]"
    below = f"CASE WHEN g.single THEN slice({_keys('g.text')}, IF(startswith(g.name, '$'), 2, 1), length(g.text)) ELSE {_keys(body)} END"
    kind = "IF(g.name = '$match', 'operator', 'expression')"
    closed = f"g.name IN ('$lookup', '$facet') AND json_object_keys({body}) IS NOT NULL"
    own = f"IF(startswith(g.name, '$'), {_typed("'stage'", 'array(g.name)')}, {_none(_FEATURES)})"
    return f"concat({own}, CASE WHEN {closed} THEN {_none(_FEATURES)} ELSE {_typed(kind, below)} END)"


def command_parts(doc: str) -> Column:
    """Texts of the command's fields that hold features, from one parse.

    Keep it as a column of its own, so that the document is parsed once.
    """
    items = ", ".join(f"{name} ARRAY<STRUCT<{', '.join(f'{f} STRING' for f in fields)}>>" for name, fields in _ITEMS.items())
    return F.from_json(doc, f"filter STRING, projection STRING, {items}, query STRING, `update` STRING, pipeline ARRAY<STRING>")


def _items(doc: str, parts: str, name: str) -> str:
    """SQL for the items of a list field, NULL where an item is no object.

    `command_parts` opens no list that has such an item; it is opened item by item.
    """
    fields = ", ".join(f"{f} STRING" for f in _ITEMS[name])
    each = f"transform(from_json({doc}, '{name} array<string>').{name}, x -> from_json(x, '{fields}'))"
    return f"coalesce({parts}.{name}, {each})"


def _times(text: str, part: str) -> str:
    """SQL for how often a text has a part."""
    return f"((length({text}) - length(replace({text}, '{part}', ''))) DIV {len(part)})"


def _needs_walk(doc: str, expr: str) -> str:
    """SQL for `needs_walk`; `expr` is SQL for a `$expr` that the text does not place.

    VARIANT keeps the last of a repeated key, so the document written out again
    has fewer texts that start with `$`, keys among them, where an object repeats
    a key and a `$` key is lost. Only documents in which some key occurs twice at
    all are read for that. Without escapes a quote and `$` are found nowhere else.
    """
    # `k` and `n` are bound by transforming one-element arrays, so each is read once.
    written = f"transform(array(to_json(try_parse_json({doc}))), t -> {_times('t', _START)})[0]"
    lost = f"transform(array({_times(doc, _START)}), n -> n > 0 AND coalesce({written}, -1) != n)[0]"
    names = rf"""regexp_extract_all({doc}, r'"([^"]*)"\s*:', 1)"""
    twice = f"transform(array({names}), k -> size(k) > size(array_distinct(k)))[0]"
    return f"(contains({doc}, r'\\') OR {expr} OR ({twice} AND {lost}))"


def _deep_expr(doc: str, command: str, parts: str) -> str:
    """SQL for a document with a `$expr` that is no first-level key of a query text."""
    tops = {c: " + ".join(f"IF(array_contains(json_object_keys({parts}.{f}), '$expr'), 1, 0)" for f in fields) for c, fields in _QUERIES.items()}
    arms = " ".join(f"WHEN '{c}' THEN {top}" for c, top in tops.items())
    return f"(contains({doc}, '{_EXPR}') AND {_times(doc, _EXPR)} != CASE {command} {arms} ELSE 0 END)"


def _query_features(text: str) -> str:
    """SQL for the features of a query text whose `$expr`, if any, is a first-level key: below it are expressions."""
    own = _typed("'operator'", "filter(array(e.key), k -> startswith(k, '$'))")
    below = _typed("IF(e.key = '$expr', 'expression', 'operator')", _keys("e.value"))
    opened = f"flatten(transform(map_entries(from_json({text}, 'map<string,string>')), e -> concat({own}, {below})))"
    return f"CASE WHEN contains({text}, '{_EXPR}') THEN coalesce({opened}, {_none(_FEATURES)}) ELSE {_typed("'operator'", _keys(text))} END"


def needs_walk(doc: str) -> Column:
    """Documents whose features cannot be read from the text alone.

    Escapes can hide keys inside text values, and `$expr` turns what lies
    below it from operators into expressions; `feature_names` reads it from the
    text only as a first-level key of a query. Of a key repeated in one object
    only the last one counts, with what lies below it; keys that occur again
    in another object are no such case.
    """
    return F.expr(_needs_walk(doc, f"contains({doc}, '{_EXPR}')"))


def feature_names(doc: str, command: str, parts: str) -> Column:
    """Array of (feature_type, feature_name), one per use.

    Arguments are column names; `parts` holds `command_parts` of `doc`.
    """
    updates, deletes = (
        f"flatten(transform({_items(doc, parts, name)}, x -> concat({', '.join(_keys(f'x.{f}') for f in fields)})))" for name, fields in _ITEMS.items()
    )
    operators = f"CASE {command} WHEN 'update' THEN {updates} WHEN 'delete' THEN {deletes} END"
    queries = " ".join(f"WHEN '{c}' THEN concat({', '.join(_query_features(f'{parts}.{f}') for f in fields)})" for c, fields in _QUERIES.items())
    staged = f"flatten(transform({_stages(parts + '.pipeline', doc)}, g -> {_stage_names()}))"
    plain = _typed("'operator'", f"coalesce({operators}, {_none('array<string>')})")
    own = f"IF({command} IN {_words(fixed.KNOWN_COMMANDS)}, {_typed("'command'", f'array({command})')}, {_none(_FEATURES)})"
    walked = f"transform({_feature_nodes(doc, command)}, f -> named_struct('feature_type', f.feature_type, 'feature_name', f.feature_name))"
    return F.expr(
        f"CASE WHEN {command} IN {_WALKED_COMMANDS} AND {_needs_walk(doc, _deep_expr(doc, command, parts))} THEN {walked} "
        f"ELSE concat({own}, CASE {command} WHEN 'aggregate' THEN {staged} {queries} ELSE {plain} END) END"
    )


# --- nodes from the VARIANT -----------------------------------------------


def _object(node: str) -> str:
    return f"try_variant_get({node}, '$', 'map<string,variant>')"


def _root(path: str, in_expr: str, node: str) -> str:
    return f"named_struct('path', {path}, 'key', '', 'outer_expr', {in_expr}, 'in_expr', {in_expr}, 'node', {node})"


def _children(arrays: bool) -> str:
    """SQL for the nodes directly below node `n`."""
    of_object = (
        f"CAST(transform(map_entries({_object('n.node')}), e -> named_struct("
        "'path', concat(n.path, '.', e.key), 'key', e.key, 'outer_expr', n.in_expr, "
        f"'in_expr', n.in_expr OR e.key = '$expr', 'node', e.value)) AS {_NODES})"
    )
    if not arrays:
        return f"coalesce({of_object}, {_none(_NODES)})"
    item = _root("concat(n.path, '[', i, ']')", "n.in_expr", "x")
    of_array = f"CAST(transform(try_variant_get(n.node, '$', 'array<variant>'), (x, i) -> {item}) AS {_NODES})"
    return f"coalesce({of_object}, {of_array}, {_none(_NODES)})"


def depth_sql(text: str) -> str:
    """SQL for the largest nesting depth of a JSON text, in one pass over its brackets.

    Escapes go first, then text literals, then all but brackets. What is folded are
    runs of opening and of closing brackets; after a run of opening ones the depth
    is largest.
    """
    plain = rf"replace(replace(coalesce({text}, ''), '\\\\', ''), '\\\"', '')"
    brackets = rf"regexp_replace(regexp_replace({plain}, '\"[^\"]*\"', ''), '[^\\[\\]{{}}]+', '')"
    runs = rf"regexp_extract_all({brackets}, r'([\[{{]+|[\]}}]+)', 1)"
    after = "d.now + IF(left(c, 1) IN ('{', '['), length(c), -length(c))"
    step = f"transform(array({after}), x -> named_struct('now', x, 'most', greatest(d.most, x)))[0]"
    return f"aggregate({runs}, named_struct('now', 0, 'most', 0), (d, c) -> {step}, d -> d.most)"


def walk_sql(roots: str, text: str, arrays: bool = True) -> str:
    """SQL for every node below the roots whose key starts with `$`.

    One level per round, and as many rounds as the document nests.
    """
    level = f"flatten(transform(s.open, n -> {_children(arrays)}))"
    step = (
        f"transform(array({level}), l -> named_struct('open', l, "
        "'seen', concat(s.seen, filter(l, n -> startswith(n.key, '$')))))[0]"
    )
    start = f"named_struct('open', CAST(coalesce({roots}, array()) AS {_NODES}), 'seen', {_none(_NODES)})"
    return f"aggregate(sequence(0, {depth_sql(text)}), {start}, (s, r) -> {step}, s -> s.seen)"


def _indexed(items: str, prefix: str, fields: tuple[str, ...]) -> str:
    roots = ", ".join(
        _root(f"concat('{prefix}[', i, '].{f}')", "false", f"try_variant_get(x, '$.{f}', 'variant')") for f in fields
    )
    return f"flatten(transform({items}, (x, i) -> array({roots})))"


def _feature_nodes(doc: str, command: str) -> str:
    tree = f"try_parse_json({doc})"

    def root_of(name: str) -> str:
        return _root(f"'command.{name}'", "false", f"try_variant_get({tree}, '$.{name}', 'variant')")

    def items_of(name: str) -> str:
        return f"try_variant_get({tree}, '$.{name}', 'array<variant>')"

    body = "try_variant_get(try_parse_json(g.text), '$', 'map<string,variant>')[g.name]"
    stage_path = "concat('command.pipeline[', g.position, '].', g.name)"
    all_stages = _stages(f"from_json({doc}, 'pipeline array<string>').pipeline", doc)
    open_stages = f"filter(all_stages, g -> NOT (g.name IN ('$lookup', '$facet') AND {_object(body)} IS NOT NULL))"
    stage_root = _root(stage_path, "g.name != '$match'", body)
    stage_roots = f"transform({open_stages}, g -> {stage_root})"
    roots = (
        f"CASE {command} "
        f"WHEN 'find' THEN CAST(array({root_of('filter')}, {root_of('projection')}) AS {_NODES}) "
        f"WHEN 'update' THEN CAST({_indexed(items_of('updates'), 'command.updates', ('q', 'u'))} AS {_NODES}) "
        f"WHEN 'delete' THEN CAST({_indexed(items_of('deletes'), 'command.deletes', ('q',))} AS {_NODES}) "
        f"WHEN 'findAndModify' THEN CAST(array({root_of('query')}, {root_of('update')}) AS {_NODES}) "
        f"WHEN 'aggregate' THEN CAST({stage_roots} AS {_NODES}) END"
    )

    def found(kind: str, name: str, path: str, value: str) -> str:
        return f"named_struct('feature_type', {kind}, 'feature_name', {name}, 'sample_path', {path}, 'sample_value', {value})"

    node = found("IF(n.outer_expr, 'expression', 'operator')", "n.key", "n.path", "to_json(n.node)")
    stage = found("'stage'", "g.name", stage_path, f"to_json({body})")
    own = found("'command'", command, f"concat('command.', {command})", f"coalesce(to_json({_object(tree)}[{command}]), 'null')")
    whole = (
        f"concat(CAST(filter(array({own}), f -> {command} IN {_words(fixed.KNOWN_COMMANDS)}) AS {_FOUND}), "
        f"CAST(transform(filter(all_stages, g -> startswith(g.name, '$')), g -> {stage}) AS {_FOUND}), "
        f"CAST(transform({walk_sql(roots, doc)}, n -> {node}) AS {_FOUND}))"
    )
    stages = f"IF({command} = 'aggregate', {all_stages}, {_none(_STAGES)})"
    return f"transform(array({stages}), all_stages -> {whole})[0]"


def feature_nodes(doc: str, command: str) -> Column:
    """Array of (feature_type, feature_name, sample_path, sample_value).

    Arguments are column names.
    """
    return F.expr(_feature_nodes(doc, command))
