"""Queries p2_ and p4_: nested records and hierarchies, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import hierarchy, nested

#: The JSON fields: table, key column, field.
FIELDS = (("buck_rules", "row_id", "variants"), ("buck_rules", "row_id", "transformation"), ("buck_glossary", "entry_id", "buck_ref"))

#: One flat table per kind of object: kind -> (fields it stands in, typed columns).
KINDS = {
    "sub_variants": (("variants",), {"form": "string"}),
    "dialects": (("variants",), {"id": "string", "certainty": "string"}),
    "examples": (("variants",), {"word": "string", "gloss": "string"}),
    "sources": (("variants",), {"siglum": "string"}),
    "lines": (("variants",), {"first": "string", "last": "string"}),
    "hand": (("variants",), {"period": "string"}),
    "scribe": (("variants",), {}),
    "steps": (("transformation",), {"from": "string", "to": "string"}),
    "context": (("transformation",), {"before": "string"}),
    "after": (("transformation",), {"class": "string"}),
    "see": (("buck_ref",), {"section": "string", "page": "string"}),
    "note": (("buck_ref",), {"text": "string"}),
    "by": (("buck_ref",), {"editor": "string"}),
}
TOP = {
    "variants": {"form": "string"},
    "transformation": {"from": "string", "to": "string"},
    "buck_ref": {"section": "string", "page": "string"},
}
#: What every node's row says of its place.
PLACE = ("field_name", "node_path", "parent_path", "kind", "ordinal")


def _kinds_of(field: str) -> list[str]:
    """The kinds of one field that have flat tables."""
    return [field, *[k for k, (fields, _) in KINDS.items() if field in fields]]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: The fields by table, so that each table is scanned once.
TABLES = (("buck_rules", "row_id", ["variants", "transformation"]), ("buck_glossary", "entry_id", ["buck_ref"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        nested.json_objects(table(spark, d, t), [k], fields, node=False).select(
            F.lit(t).alias("table_name"), F.col(k).alias("row_id"), "field_name", "node_path"
        )
        for t, k, fields in TABLES
    ]
    return parts[0].unionByName(parts[1])


def p2_flat(kind: str):
    """The query for one kind: rows name their parent node and their rule or glossary row."""
    fields, columns = KINDS[kind] if kind in KINDS else ((kind,), TOP[kind])
    home = {f: (t, k) for t, k, f in FIELDS}

    def query(spark: SparkSession, d: str) -> DataFrame:
        t, k = home[fields[0]]
        return nested.flat_table(table(spark, d, t), [k], fields[0], kind, columns)

    return query


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every scalar of the fields as a child row of its object: plain array items, plain values where others hold objects, all else."""
    parts = [
        nested.json_values(table(spark, d, t), [k], f).select(F.lit(t).alias("table_name"), F.col(k).alias("row_id"), *PLACE, "value")
        for t, k, f in FIELDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_other(spark: SparkSession, d: str) -> DataFrame:
    """Objects of kinds without a flat table of their own, so that none is dropped; ``p2_values`` has their values."""
    parts = [
        nested.json_objects(table(spark, d, t), [k], f).where(~F.col("kind").isin(_kinds_of(f))).select(F.lit(t).alias("table_name"), F.col(k).alias("row_id"), *PLACE)
        for t, k, f in FIELDS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _dialects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return hierarchy.hierarchy(table(spark, d, "buck_dialects"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, rings = _dialects(spark, d)
    return hierarchy.ancestor_pairs(nodes, rings)


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    links, nodes, _ = _dialects(spark, d)
    return hierarchy.described(links, nodes)


def p4_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The dialects that lie on a ring, with the ring's size."""
    _, _, rings = _dialects(spark, d)
    names = rings.groupBy("ring").agg(F.min("v").alias("name"))
    return rings.join(names, "ring").select(F.col("v").alias("id"), F.col("name").alias("ring"), F.col("n").alias("ring_size"))


QUERIES = {
    "p2_found": p2_found,
    **{f"p2_{k}": p2_flat(k) for k in (*TOP, *KINDS)},
    "p2_values": p2_values,
    "p2_other": p2_other,
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_cycles": p4_cycles,
}

# DuckDB walks the same JSON with a recursive query.


def _walk_sql(t: str, k: str, f: str, wanted: str = "json_type(v) = 'OBJECT'") -> str:
    inner = f"""with recursive u(row_id, x) as (select {k}, {f} from {t} where {f} is not null
  union all select row_id, json_extract_string(x, '$') from u where json_valid(x) and json_type(x) = 'VARCHAR') select row_id, x from u"""
    return f"""
select '{t}' as table_name, row_id, '{f}' as field_name, node_path, owner, kind, ordinal, v from (
 with recursive w(row_id, node_path, owner, kind, ordinal, v) as (
  select row_id, '{f}', null::varchar, '{f}', null::bigint, x::json from ({inner}) where json_valid(x) and json_type(x) in ('OBJECT', 'ARRAY')
  union all
  select row_id,
    case when json_type(v) = 'OBJECT' then node_path || '.' || k else node_path || '[' || i || ']' end,
    case when json_type(v) = 'OBJECT' then node_path else owner end,
    case when json_type(v) = 'OBJECT' then k else kind end,
    case when json_type(v) = 'OBJECT' then null else i end,
    case when json_type(v) = 'OBJECT' then json_extract(v, '$."' || k || '"') else json_extract(v, '$[' || i || ']') end
  from (select *, unnest(case when json_type(v) = 'OBJECT' then json_keys(v) else list_transform(range(json_array_length(v)::bigint), lambda z: z::varchar) end) as k,
        unnest(case when json_type(v) = 'OBJECT' then range(len(json_keys(v))) else range(json_array_length(v)::bigint) end) as i
        from w where json_type(v) in ('OBJECT', 'ARRAY')))
 select * from w where {wanted})"""


def _flat_sql(kind: str) -> str:
    fields, columns = KINDS[kind] if kind in KINDS else ((kind,), TOP[kind])
    t, k, f = next(x for x in FIELDS if x[2] == fields[0])
    cols = "".join(
        f""", case when json_type(v, '$."{c}"') in ('OBJECT', 'ARRAY', 'NULL') then null else json_extract_string(v, '$."{c}"') end as "{c}\"""" for c in columns
    )
    return f"""select row_id as {k}, field_name, node_path, owner as parent_path, ordinal::int as ordinal{cols}
from ({_walk_sql(t, k, f)}) where kind = '{kind}'"""


_PLACE = "table_name, row_id, field_name, node_path, owner as parent_path, kind, ordinal::int as ordinal"
_VALUES = " union all ".join(f"""select {_PLACE}, json_extract_string(v, '$') as value from ({_walk_sql(*x, wanted="json_type(v) not in ('OBJECT', 'ARRAY')")})""" for x in FIELDS)
_OTHER = " union all ".join(f"select {_PLACE} from ({_walk_sql(*x)}) where kind not in ({str(_kinds_of(x[2]))[1:-1]})" for x in FIELDS)

_LATEST = """
latest as (select v, nullif(arg_max(p, (loaded_at, row_id)), '') as p from (
  select lower(trim(id)) as v, coalesce(lower(trim(parent)), '') as p, loaded_at, row_id from buck_dialects) where v <> '' group by v),
links as (select v, case when p in (select v from latest) then p end as p from latest)"""

ORACLE_SQL = {
    "p2_found": " union all ".join(f"select table_name, row_id, field_name, node_path from ({_walk_sql(*x)})" for x in FIELDS),
    **{f"p2_{k}": _flat_sql(k) for k in (*TOP, *KINDS)},
    "p2_values": _VALUES,
    "p2_other": _OTHER,
    "p4_found": f"""with recursive {_LATEST},
up(ancestor_id, descendant_id, steps) as (
  select p, v, 1 from links where p is not null
  union
  select l.p, u.descendant_id, u.steps + 1 from up u join links l on l.v = u.ancestor_id
  where l.p is not null and u.steps <= (select count(*) from links))
select ancestor_id, descendant_id, min(steps)::int as steps from up group by 1, 2""",
    "p4_hierarchy": f"""with recursive {_LATEST},
label as (select v, arg_max(g, (loaded_at, row_id)) as g from (select lower(trim(id)) as v, struct_pack(g := dialect_group) as g, loaded_at, row_id from buck_dialects) group by v),
up(a, d, steps) as (
  select p, v, 1 from links where p is not null
  union
  select l.p, u.d, u.steps + 1 from up u join links l on l.v = u.a where l.p is not null and u.steps <= (select count(*) from links) and u.a <> u.d),
ring as (select distinct d as v from up where a = d),
way(d, a, steps) as (select v, v, 0 from links union all select w.d, l.p, w.steps + 1 from way w join links l on l.v = w.a where l.p is not null and w.a not in (select v from ring)),
per as (select d, arg_max(a, steps) as base, max(steps) as depth, string_agg(a, '/' order by steps desc) as path from way group by d)
select d as id, case when r.v is null then base end as root, case when r.v is null then depth::int end as depth, path, coalesce(r.v = d, false) as on_cycle, r.v as cycle_entry,
 l.g.g as label, case when r.v is null then b.g.g end as root_label
from per left join ring r on r.v = base left join label l on l.v = d left join label b on b.v = base""",
    "p4_cycles": f"""with recursive {_LATEST},
up(a, d, steps) as (
  select p, v, 1 from links where p is not null
  union
  select l.p, u.d, u.steps + 1 from up u join links l on l.v = u.a where l.p is not null and u.steps <= (select count(*) from links) and u.a <> u.d)
select c.d as id, (select min(x.a) from up x where x.d = c.d) as ring, c.steps::int as ring_size from up c where c.a = c.d""",
}
