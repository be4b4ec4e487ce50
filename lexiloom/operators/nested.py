"""Deeply nested JSON records turned into related flat tables.

One higher-order SQL projection does the work: ``aggregate`` repeats, as often as
the text can be deep, a ``transform`` over the current level's nodes whose inner
``transform`` calls attach the ancestor's path and the child's key or index, and
``flatten`` joins the children's arrays; ``inline`` then emits one row per node.
No schema is assumed: values are read as VARIANT, so scalars, objects and arrays
may change places.  Each level takes its nodes apart by one step, so the work is in
proportion to the nodes.

Defined results: a null, blank or incomplete text gives no rows; a text whose whole
value is a JSON string holding JSON is read as that JSON, however often it was
encoded; a repeated key keeps its last value (this needs, and sets, the session's
``spark.sql.variant.allowDuplicateKeys``); nulls in arrays count for the index; text
nested deeper than the JSON parser takes (1,000) counts as broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "struct<path:string,parent:string,key:string,idx:int,obj:map<string,variant>,arr:array<variant>,value:variant>"


# The expressions bind what they use twice as a lambda's variable, so that Catalyst cannot copy it: ``let``.


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def complete(text: str) -> str:
    """The text's value as VARIANT; null if it is no JSON or more stands after it.

    The parser stops after the first value, so the text is read as the first of two items
    of an array, the second being the text's own hash.
    """
    both = f"try_variant_get(try_parse_json(concat('[', {text}, ',', seal, ']')), '$', 'array<variant>')"
    checked = "case when size(both) = 2 and try_variant_get(both[1], '$', 'bigint') = seal then both[0] end"
    return _let("seal", f"xxhash64({text})", _let("both", both, checked))


def unwrap(text: str) -> str:
    """Undo whole-value string encodings; null if what stands in the string is no JSON text.

    Each encoding doubles a text at least, so its length tells how many there can be.
    """
    quoted = r"""{0} rlike '^\\s*"'"""
    once = f"case when {quoted.format('u')} then try_variant_get({complete('u')}, '$', 'string') else u end"
    most = f"cast(ceil(log2(length({text}) + 1)) as int)"
    return f"case when {quoted.format(text)} then aggregate(sequence(1, {most}), {text}, (u, i) -> {once}) else {text} end"


def _node(path: str, parent: str, key: str, idx: str, value: str, taken: str = "") -> str:
    """A node; ``taken`` is a struct that holds its value taken apart already."""
    obj, arr = (f"{taken}.obj", f"{taken}.arr") if taken else (f"try_variant_get({value}, '$', 'map<string,variant>')", f"try_variant_get({value}, '$', 'array<variant>')")
    return f"named_struct('path', {path}, 'parent', {parent}, 'key', {key}, 'idx', {idx}, 'obj', {obj}, 'arr', {arr}, 'value', {value})"


_TAKEN = "named_struct('key', {0}, 'idx', {1}, 'obj', try_variant_get({2}, '$', 'map<string,variant>'), 'arr', try_variant_get({2}, '$', 'array<variant>'), 'value', {2})"


def _children(scalars: bool) -> str:
    """All children of a level's nodes; without scalars no place is spelt out for them."""
    chosen = lambda items: items if scalars else f"filter({items}, x -> x.obj is not null or x.arr is not null)"
    in_obj = chosen(f"transform(map_entries(n.obj), e -> {_TAKEN.format('e.key', 'cast(null as int)', 'e.value')})")
    in_arr = chosen(f"transform(n.arr, (v, i) -> {_TAKEN.format('n.key', 'i', 'v')})")
    return f"""
flatten(transform(acc.level, n -> case
  when n.obj is not null then transform({in_obj}, x -> {_node("concat(n.path, '.', x.key)", "n.path", "x.key", "x.idx", "x.value", "x")})
  when n.arr is not null then transform({in_arr}, x -> {_node("concat(n.path, '[', x.idx, ']')", "n.parent", "x.key", "x.idx", "x.value", "x")})
  else cast(array() as array<{NODE}>) end))
"""


# a text is no deeper than it has opening brackets
_OPENING = "'[{'"
_WALK = f"""
aggregate(
  sequence(1, 1 + least(1000, length(text) - length(translate(text, {_OPENING}, '')))),
  named_struct('found', cast(array() as array<{{found}}>), 'level', cast(array({_node("_field", "cast(null as string)", "_field", "cast(null as int)", "root")}) as array<{NODE}>)),
  (acc, i) -> if(size(acc.level) = 0, acc, named_struct(
    'found', concat(acc.found, cast(transform(filter(acc.level, n -> {{wanted}}), n -> {{kept}}) as array<{{found}}>)),
    'level', {{children}})),
  acc -> acc.found)
"""
_PLACE = "path:string,parent:string,key:string,idx:int"
_KEPT = "named_struct('path', n.path, 'parent', n.parent, 'key', n.key, 'idx', n.idx{more})"


def _walk(wanted: str, more: str = "", kind: str = "", scalars: bool = False) -> str:
    found = f"struct<{_PLACE}{kind}>"
    walk = _WALK.replace("{children}", _children(scalars)).replace("{found}", found).replace("{wanted}", wanted).replace("{kept}", _KEPT.replace("{more}", more))
    value = _let("root", complete("text"), f"case when root is not null then {walk} end")
    return _let("text", unwrap("_text"), rf"case when text rlike '^\\s*[\\[{{]' then {value} end")


_OBJECTS = _walk("n.obj is not null", ", 'node', n.obj", ",node:map<string,variant>")
_PLACES = _walk("n.obj is not null")
_SCALARS = _walk("n.obj is null and n.arr is null", ", 'node', n.value", ",node:variant", scalars=True)


def json_objects(df: DataFrame, keys: list[str], field: str | list[str], kind: str | None = None, node: bool = True) -> DataFrame:
    """One row per JSON object at any depth of ``df[field]``, or per object of one ``kind``.

    Columns: ``keys``, ``field_name``, ``node_path``, ``parent_path`` (the nearest
    enclosing object, null at the top), ``kind`` (the key the object stands under),
    ``ordinal`` (its place in an array, or null) and, if asked for, ``node``
    (MAP<STRING, VARIANT>).  ``keys`` must name the row; several fields are read in one
    scan; other columns of ``df`` are not read.
    """
    return _nodes(df, keys, field, kind, _OBJECTS if node else _PLACES)


def json_values(df: DataFrame, keys: list[str], field: str | list[str]) -> DataFrame:
    """One row per scalar at any depth of ``df[field]``, JSON nulls included, with its ``value`` as text.

    Columns as for ``json_objects``; ``parent_path`` is the object that holds the value or
    the array it stands in, so a plain item is a child like an object in its place.
    """
    rows = _nodes(df, keys, field, None, _SCALARS)
    return rows.withColumn("value", F.try_variant_get("node", "$", "string")).drop("node")


def _nodes(df: DataFrame, keys: list[str], field: str | list[str], kind: str | None, walk: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    ids = [f"_k{i}" for i in range(len(keys))]
    fields = [field] if isinstance(field, str) else field
    nodes = F.col("_nodes")
    if kind is not None:
        nodes = F.filter(nodes, lambda n: n["key"] == kind)
    given = [F.col(k).alias(i) for i, k in zip(ids, keys, strict=True)]
    if len(fields) == 1:
        texts = df.select(*given, F.lit(fields[0]).alias("_field"), F.col(fields[0]).alias("_text"))
    else:
        texts = df.select(*given, F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), F.col(f).alias("_text")) for f in fields])))
    return (
        texts.where(F.col("_text").isNotNull())
        .select(*ids, "_field", F.expr(walk).alias("_nodes"))
        .select(*ids, "_field", F.inline(nodes))
        .select(
            *[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)],
            F.col("_field").alias("field_name"),
            F.col("path").alias("node_path"),
            F.col("parent").alias("parent_path"),
            F.col("key").alias("kind"),
            F.col("idx").alias("ordinal"),
            *([F.col("node")] if walk is not _PLACES else []),
        )
    )


def flat_table(df: DataFrame, keys: list[str], field: str, kind: str, columns: dict[str, str]) -> DataFrame:
    """The objects of one kind as a flat table: parent link, place, and ``columns`` (name -> type).

    A column whose value cannot take the type, or is missing, is null.
    """
    rows = json_objects(df, keys, field, kind)
    return rows.select(
        *keys,
        "field_name",
        "node_path",
        "parent_path",
        "ordinal",
        *[F.try_variant_get(F.try_element_at("node", F.lit(c)), "$", t).alias(c) for c, t in columns.items()],
    )
