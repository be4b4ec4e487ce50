"""One consistent form for text that looks the same but holds different characters (p1).

Arrow partitions are handed to DuckDB, whose embedded SQL removes invisible
characters, composes (``nfc_normalize``), maps compatibility forms (a map lookup per
character, for texts that hold any), full-width forms, ligatures and look-alike letters
(``translate``, ``replace``), repairs letters that lose their dot under an accent
(``regexp_replace``), composes again and unifies blanks.

Two texts get the same form if and only if the tables below make them look alike.
Compatibility forms come from the Unicode tables by rule: those that differ in font,
width, joining or as ligatures, squares and symbol letters look like what they stand for.
Raised, lowered, circled and fractional ones do not, so they are mapped only if ``loose``
is asked for; a few that Unicode calls compatible but look otherwise never are.
Case, accents, breathings, punctuation and final sigma stay.  Defined results: null
stays null; empty and blank texts give ''; texts of any length are processed whole.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import rows_within

# Letters that look like the first letter of their row.
LOOKALIKES = (
    ("α", "ɑ"), ("β", "ß"), ("γ", "ɣ"), ("δ", "ẟ"), ("ε", "ɛ"), ("ι", "ıɩ"), ("κ", "ĸк"), ("μ", "µ"), ("ν", "vѵᴠ"),
    ("ο", "oоօ"), ("ρ", "pрϼ"), ("υ", "ʋ"), ("φ", "ɸ"), ("θ", "ѳ"), ("η", "ƞ"),
    ("Α", "AА"), ("Β", "BВ"), ("Γ", "Г"), ("Ε", "EЕ"), ("Ζ", "Z"), ("Η", "HН"), ("Ι", "IІӀ"), ("Κ", "KКK"), ("Μ", "MМ"),
    ("Ν", "N"), ("Ο", "OОՕ"), ("Π", "П"), ("Ρ", "PР"), ("Τ", "TТ"), ("Υ", "YҮ"), ("Φ", "Ф"), ("Χ", "XХ"), ("Θ", "Ѳ"), ("Ω", "Ω"),
    ("a", "а"), ("c", "сϲ"), ("d", "ԁ"), ("e", "е"), ("h", "һ"), ("i", "і"), ("j", "ј"), ("l", "ⅼ"), ("q", "ԛ"), ("s", "ѕ"), ("w", "ԝ"), ("x", "х"), ("y", "у"),
    ("C", "СϹ"), ("D", "Ⅾ"), ("G", "Ԍ"), ("J", "Ј"), ("L", "Ⅼ"), ("Q", "Ԛ"), ("S", "Ѕ"), ("V", "ѴⅤ"), ("W", "Ԝ"),
    ("-", "‐‑−"), (".", "․"), ("·", "•∙⋅"), ("'", "’ʼ"),
)

# Combining marks that look like the first of their row.
MARKS = (("͂", "̃"), ("̓", "҆"), ("̔", "҅"))

#: Removed: format characters, controls but blanks, selectors and fillers.
INVISIBLE = r"[\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
#: Marks above a letter, under which i and j lose their dot.
ABOVE = "[̀-̷̸̂̈͂̓̔]"


def mapping() -> tuple[dict[str, str], dict[str, str]]:
    """Single-character and multi-character replacements, by rule from the tables above."""
    base = {other: row[0] for row in LOOKALIKES for other in row[1]}
    one = dict(base)
    one.update({other: row[0] for row in MARKS for other in row[1]})
    # full-width ASCII
    one.update({chr(0xFF01 + k): base.get(chr(0x21 + k), chr(0x21 + k)) for k in range(94)})
    many = {}
    # composed letters on a look-alike base: i under an accent has no dot and looks like iota
    above = base | {"i": "ι", "і": "ι"}
    marks = {other: row[0] for row in MARKS for other in row[1]}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and c not in one and parts[0] in above and unicodedata.normalize("NFC", c) == c:
            new = unicodedata.normalize("NFC", above[parts[0]] + "".join(marks.get(m, m) for m in parts[1:]))
            if unicodedata.combining(parts[1]) == 230 or parts[0] in base:
                (one if len(new) == 1 else many)[c] = new
    # ligatures and Roman numerals look like their letters
    for code in (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180)):
        c = chr(code)
        wide = unicodedata.normalize("NFKC", c)
        if c not in one and wide != c:
            new = "".join(one.get(x, x) for x in wide)
            (one if len(new) == 1 else many)[c] = new
    return one, many


# Compatible by Unicode, of another look: long s, omega-like pi, lunate sigmas (they look like c).
OTHER_LOOK = frozenset("ſϖϲϹẛ")
#: Decompositions that change the look; the others keep it.
LOOSE_TAGS = frozenset({"<super>", "<sub>", "<circle>", "<fraction>"})


@lru_cache(maxsize=2)
def compatible(loose: bool = False) -> dict[str, str]:
    """Compatibility forms and what they look like, where ``mapping`` has none."""
    one, many = mapping()
    out = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if tag[:1] != "<" or c in one or c in many or c in OTHER_LOOK or (tag in LOOSE_TAGS and not loose):
            continue
        plain = unicodedata.normalize("NFKC", c)
        # spacing accents would become a blank and a mark
        if " " not in plain and plain != c:
            out[c] = plain
    return out


def _class(chars: Iterable[str]) -> str:
    """A bracket expression of ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def plain_sql(x: str, loose: bool = False) -> str:
    """The embedded query that replaces the compatibility forms of column ``x`` of ``batch``, as column ``_x``.

    ``forms`` is a table of the characters; only texts that hold one are taken apart.
    """
    return f"""with numbered as (select row_number() over () as _r, * from batch),
chars as (select _r, c, i from (select _r, unnest(regexp_extract_all({x}, '(?s).')) as c, unnest(range(length({x}) * 4)) as i
  from numbered where regexp_matches({x}, '{_class(compatible(loose))}')) where c is not null),
plain as (select _r, string_agg(coalesce(f.plain, c), '' order by i) as p from chars left join forms f using (c) group by 1)
select n.* exclude (_r), coalesce(p, {x}) as _x from numbered n left join plain using (_r)"""


def canonical_sql(x: str) -> str:
    """The embedded expression over column ``x``, which holds no compatibility forms but the table's own."""
    one, many = mapping()

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    # a text of none but these letters, digits and marks needs no more than its blanks unified
    safe = [
        chr(c)
        for c in (*range(0x20, 0x7F), *range(0x370, 0x400), *range(0x1F00, 0x2000))
        if chr(c) not in one and chr(c) not in many and unicodedata.normalize("NFC", chr(c)) == chr(c) and (c < 0x7F or unicodedata.category(chr(c))[0] == "L")
    ]
    odd = "[^" + "".join(rf"\x{{{ord(c):x}}}" for c in safe) + "]"
    e = f"nfc_normalize(regexp_replace({x}, '{INVISIBLE}', '', 'g'))"
    e = f"translate({e}, {q(''.join(one))}, {q(''.join(one.values()))})"
    several = e
    for c, new in many.items():
        several = f"replace({several}, {q(c)}, {q(new)})"
    pattern = "[" + "".join(many) + "]"
    e = f"case when regexp_matches({x}, '{pattern}') then {several} else {e} end"
    e = f"nfc_normalize(regexp_replace({e}, '[ij]({ABOVE})', 'ι\\1', 'g'))"
    e = f"case when regexp_matches({x}, '{odd}') then {e} else {x} end"
    return f"trim(regexp_replace({e}, '{BLANKS}', ' ', 'g'))"


def canonical(df: DataFrame, keep: list[str], value: str, out: str = "form", loose: bool = False) -> DataFrame:
    """``keep`` columns and ``value`` of ``df``, and the value's consistent form as ``out``.

    DuckDB runs in each Python worker on one thread, batch by batch, so memory does
    not grow with the partition.
    """
    narrow = df.select(*keep, value)
    x = '"' + value.replace('"', '""') + '"'
    some = f"select count(*) from batch where regexp_matches({x}, '{_class(compatible(loose))}')"
    plain = f"select * exclude (_x), {canonical_sql('_x')} as \"{out}\" from ({plain_sql(x, loose)})"
    sql = f"select *, {canonical_sql(x)} as \"{out}\" from batch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        forms = compatible(loose)
        con.register("given", pa.table({"c": list(forms), "plain": list(forms.values())}))
        con.execute("create table forms as select * from given")
        for b in batches:
            if b.num_rows:
                con.register("batch", pa.Table.from_batches([b]))
                held = con.sql(some).fetchall()[0][0]
                yield from con.sql(plain if held else sql).to_arrow_table().to_batches()
                con.unregister("batch")

    from pyspark.sql import types as T

    schema = T.StructType([*narrow.schema.fields, T.StructField(out, T.StringType())])
    return narrow.mapInArrow(run, schema)


#: A reference list up to this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_FORMS = 100_000


def known_forms(forms: DataFrame, form_id: str = "form_id", form: str = "form") -> DataFrame:
    """(form_id, known, looks): the reference list with each form's consistent form.

    Of forms that look alike, the one with the smallest id stands for all.
    """
    looks = canonical(forms.where(F.col(form).isNotNull()), [form_id], form, "looks")
    best = looks.groupBy("looks").agg(F.min(F.struct(F.col(form_id), F.col(form))).alias("best"))
    out = best.select("looks", F.col(f"best.{form_id}").alias("form_id"), F.col(f"best.{form}").alias("known"))
    return F.broadcast(out) if rows_within(forms, BROADCAST_FORMS) else out


def regularise(values: DataFrame, keep: list[str], value: str, forms: DataFrame) -> DataFrame:
    """``keep``, ``value``, its consistent form ``looks``, and ``form_id`` / ``known`` of the form it looks like."""
    return canonical(values, keep, value, "looks").join(known_forms(forms), "looks", "left")


def disguised(values: DataFrame, keep: list[str], value: str, forms: DataFrame) -> DataFrame:
    """The values that look like a known form but equal none once ASCII blanks are reduced."""
    plain = F.trim(F.regexp_replace(value, "[ \t\n]+", " "))
    exact = forms.select(F.col("form").alias("_exact")).distinct()
    exact = F.broadcast(exact) if rows_within(forms, BROADCAST_FORMS) else exact
    hit = canonical(values.where(F.col(value).isNotNull()), keep, value, "looks").join(known_forms(forms), "looks")
    return hit.withColumn("_plain", plain).join(exact, F.col("_plain") == F.col("_exact"), "left_anti").drop("_plain")
