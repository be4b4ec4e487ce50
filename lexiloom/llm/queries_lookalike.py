"""Queries p1_: consistent forms of spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import lookalike

FIELDS = (("choice_records", "record_id", ("original", "regularized")), ("correspondence_entries", "entry_id", ("normalized",)))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, field_name, value) of every field in question."""
    parts = []
    for t, k, fields in FIELDS:
        pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
        parts.append(_table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(k).alias("row_id"), F.inline(pairs)))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["table_name", "row_id", "field_name"]
    return lookalike.disguised(_values(spark, d), keys, "value", _table(spark, d, "word_forms")).select(*keys, "form_id")


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its consistent form: the known form it looks like, else the mapped text."""
    keys = ["table_name", "row_id", "field_name"]
    out = lookalike.regularise(_values(spark, d), keys, "value", _table(spark, d, "word_forms"))
    return out.select(*keys, F.coalesce("known", "looks").alias("consistent"), "form_id")


QUERIES = {"p1_found": p1_found, "p1_consistent": p1_consistent}


# The SQL is written apart from the operator: a literal table of pairs, joined character by character.
_PAIRS = """
 ('ɑ','α'), ('ß','β'), ('ɣ','γ'), ('ẟ','δ'), ('ɛ','ε'), ('ı','ι'), ('ɩ','ι'), ('ĸ','κ'), ('к','κ'), ('µ','μ'), ('v','ν'), ('ѵ','ν'), ('ᴠ','ν'), ('o','ο'), ('о','ο'), ('օ','ο'),
 ('p','ρ'), ('р','ρ'), ('ϼ','ρ'), ('ʋ','υ'), ('ɸ','φ'), ('ѳ','θ'), ('ƞ','η'), ('A','Α'), ('А','Α'), ('B','Β'), ('В','Β'), ('Г','Γ'), ('E','Ε'), ('Е','Ε'), ('Z','Ζ'), ('H','Η'), ('Н','Η'),
 ('I','Ι'), ('І','Ι'), ('Ӏ','Ι'), ('K','Κ'), ('К','Κ'), ('M','Μ'), ('М','Μ'), ('N','Ν'), ('O','Ο'), ('О','Ο'), ('Օ','Ο'), ('П','Π'), ('P','Ρ'), ('Р','Ρ'), ('T','Τ'), ('Т','Τ'), ('Y','Υ'),
 ('Ү','Υ'), ('Ф','Φ'), ('X','Χ'), ('Х','Χ'), ('Ѳ','Θ'), ('а','a'), ('с','c'), ('ϲ','c'), ('ԁ','d'), ('е','e'), ('һ','h'), ('і','i'), ('ј','j'), ('ԛ','q'), ('ѕ','s'), ('ԝ','w'), ('х','x'), ('у','y'),
 ('С','C'), ('Ϲ','C'), ('Ԍ','G'), ('Ј','J'), ('Ԛ','Q'), ('Ѕ','S'), ('Ѵ','V'), ('Ԝ','W'), ('‐','-'), ('‑','-'), ('−','-'), ('․','.'), ('•','·'), ('∙','·'), ('⋅','·'), ('’',''''), ('ʼ',''''),
 ('̃','͂'), ('҆','̓'), ('҅','̔')"""
_MARKS = "('̀'), ('́'), ('͂'), ('̃'), ('̈'), ('̓'), ('̔')"
_LIGATURES = "('ﬀ','ff'), ('ﬁ','fi'), ('ﬂ','fl'), ('ﬃ','ffi'), ('ﬄ','ffl'), ('ﬆ','st')"
_HIDDEN = r"[\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\x{34f}\x{fe00}-\x{fe0f}]"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_DOTTED = "[ij]([̀́͂̈̓̔])"


def _sql(found: bool) -> str:
    values = " union all ".join(
        f"select '{t}' as table_name, {k} as row_id, '{f}' as field_name, {f} as value from {t}" for t, k, fs in FIELDS for f in fs
    )
    body = f"""with pairs(a, b) as (values {_PAIRS}), marks(m) as (values {_MARKS}),
wide as (select chr(65248 + i) as a, chr(i) as b from (select unnest(range(33, 127))::int as i)),
single as (select * from pairs union all select w.a, coalesce(p.b, w.b) from wide w left join pairs p on p.a = w.b union all values {_LIGATURES}),
accented as (select nfc_normalize(a || m) as a, nfc_normalize(b || m) as b from (select * from pairs union all values ('i', 'ι')), marks),
twice as (select nfc_normalize(a || m) as a, nfc_normalize(b || m) as b from accented, marks),
map as (select a, min(b) as b from (select * from single union all select * from accented where length(a) = 1 union all select * from twice where length(a) = 1) group by 1),
every as (select table_name, row_id, field_name, value, null::bigint as form_id from ({values}) union all select 'word_forms', form_id, 'form', form, form_id from word_forms),
texts as (select distinct value, nfc_normalize(regexp_replace(value, '{_HIDDEN}', '', 'g')) as t from every where value is not null),
chars as (select value, c, i from (select value, unnest(regexp_extract_all(t, '(?s).')) as c, unnest(range(length(t) * 4)) as i from texts) where c is not null),
joined as (select value, string_agg(coalesce(b, c), '' order by i) as t from chars left join map on map.a = chars.c group by 1),
looked as (select value, trim(regexp_replace(nfc_normalize(regexp_replace(coalesce(j.t, ''), '{_DOTTED}', 'ι\\1', 'g')), '{_BLANK}', ' ', 'g')) as looks from texts left join joined j using (value)),
v as (select e.*, looks from every e left join looked using (value)),
w as (select looks, arg_min(value, form_id) as known, min(form_id) as form_id from v where form_id is not null group by 1)
"""
    if not found:
        return body + "select table_name, row_id, field_name, coalesce(known, v.looks) as consistent, w.form_id from v left join w on v.looks = w.looks where table_name <> 'word_forms'"
    return body + """select table_name, row_id, field_name, w.form_id from v join w on v.looks = w.looks
where table_name <> 'word_forms' and trim(regexp_replace(value, '[ \t\n]+', ' ', 'g'), ' ') not in (select form from word_forms)"""


ORACLE_SQL = {"p1_found": _sql(True), "p1_consistent": _sql(False)}
