"""Features of command documents, counted in each document, in Arrow batches.

What a document holds is read as `walk.feature_names` reads it, which stays the
way for the few documents that are left open here (NULL).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, functions as F

from portlens import fixed

USES = "array<struct<feature_type string, feature_name string, n bigint>>"


def _reader():
    """The function on batches; what it calls is defined inside, so that workers receive it with the plan."""
    queries = {"find": ("filter", "projection"), "findAndModify": ("query", "update")}
    items = {"update": ("q", "u"), "delete": ("q",)}

    def refuse(word):
        raise ValueError(f"left open: {word}")

    def below(root, expression, found):
        """Counts the `$` keys below a node; below `$expr` they are expressions."""
        todo = [(root, expression)]
        while todo:
            node, inside = todo.pop()
            if type(node) is dict:
                kind = "expression" if inside else "operator"
                for key, child in node.items():
                    if key.startswith("$"):
                        found[kind, key] = found.get((kind, key), 0) + 1
                    if type(child) is dict or type(child) is list:
                        todo.append((child, inside or key == "$expr"))
            elif type(node) is list:
                todo.extend((child, inside) for child in node if type(child) is dict or type(child) is list)

    def plain(value):
        """The value, unless it is a text that may hold a document."""
        return refuse("text") if type(value) is str and '"' in value else value

    def stages(pipeline, found):
        """Counts the stages of a pipeline and of those nested in it, and what is below them."""
        todo = [pipeline]
        while todo:
            listed = plain(todo.pop())
            for stage in listed if type(listed) is list else ():
                if type(plain(stage)) is not dict or not stage:
                    continue
                name, body = next(iter(stage.items()))
                if name.startswith("$"):
                    found["stage", name] = found.get(("stage", name), 0) + 1
                nests = name == "$lookup" or name == "$facet"
                if nests and type(plain(body)) is dict:
                    todo.extend(body.values() if name == "$facet" else [body.get("pipeline")])
                else:
                    below(body, name != "$match", found)

    def uses(decode, doc, command):
        found = {("command", command): 1} if command else {}
        if command != "aggregate" and command not in queries and command not in items:
            return found
        text = str(doc or b"", "utf-8")
        # A lone half of a pair of escapes is no text that Arrow could hold.
        tree = refuse("escape") if "\\ud" in text or "\\uD" in text else decode(text)
        if type(tree) is not dict:
            refuse("no object")
        if command == "aggregate":
            stages(tree.get("pipeline"), found)
        for field in queries.get(command, ()):
            below(tree.get(field), False, found)
        listed = tree.get(f"{command}s") if command in items else None
        for item in listed if type(listed) is list else ():
            if type(item) is dict:
                for field in items[command]:
                    below(item.get(field), False, found)
        return found

    def read(docs: pa.Array, commands: pa.Array) -> pa.Array:
        decode = json.JSONDecoder(parse_constant=refuse).decode
        kinds, names, counts, ends, open_ = [], [], [], [0], []
        for doc, command in zip(docs.to_pylist(), commands.to_pylist(), strict=True):
            try:
                found = uses(decode, doc, command)
                open_.append(False)
            except (ValueError, RecursionError):
                found = {}
                open_.append(True)
            for (kind, name), n in found.items():
                kinds.append(kind)
                names.append(name)
                counts.append(n)
            ends.append(len(kinds))
        each = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["feature_type", "feature_name", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=pa.array(open_, pa.bool_()))

    return read


def counted_features(doc: str, command: str) -> Column:
    """Array of (feature_type, feature_name, n), each feature of a document once; NULL for what is left to `feature_names`.

    Left open are documents that are no whole JSON object, and those in which a
    text stands where a stage or pipeline is due. Arguments are column names.
    """
    known = F.when(F.col(command).isin(*fixed.KNOWN_COMMANDS), F.col(command))
    return F.arrow_udf(_reader(), USES)(F.col(doc).cast("binary"), known)
