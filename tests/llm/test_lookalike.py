import unicodedata

import pytest

from lexiloom.llm import lookalike as L

FORMS = [(1, "ὄνομα"), (2, "fr. a νόμος"), (3, "col. 2"), (4, "Κόρη"), (5, "[κῆπος] fin.")]


@pytest.fixture(scope="module")
def forms(spark):
    return spark.createDataFrame(FORMS, "form_id long, form string")


def looks(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    return [r["looks"] for r in L.canonical(df, ["id"], "v", "looks").orderBy("id").collect()]


def test_same_looks_same_form(spark):
    nfd = unicodedata.normalize("NFD", "ὄνομα")
    same = ["ὄνομα", nfd, "​ὄνο­μα﻿", "ὄνοµα", "ὄνoμα", "　ὄνομɑ "]
    assert len(set(looks(spark, same))) == 1
    assert looks(spark, ["ﬁn", "ｆｉｎ"])[0] == looks(spark, ["fin"])[0]
    assert looks(spark, ["κí", "κı́", "κί"]) == ["κί"] * 3  # an accent takes the dot of i


def test_different_looks_stay_apart(spark):
    out = looks(spark, ["κόρη", "Κόρη", "κορη", "κὸρη", "κόρης", "κόρησ", "κόρη.", "κό ρη", "ϲ", "ς"])
    assert len(set(out)) == len(out)


def test_nulls_empty_long(spark):
    out = looks(spark, [None, "", " \t\n", "ὄνoμα " * 50_000])
    assert out[:3] == [None, "", ""] and len(out[3]) == 6 * 50_000 - 1


def test_found_and_no_case(spark, forms):
    values = ["ὄνoμα", "ὄνομα", "  ὄνομα\n", "fr. a  νόμος", "fr.\ta\n νόμος", "col．２", "ΚΌΡΗ", None, " ὄνομα"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    got = {(r["id"], r["form_id"]) for r in L.disguised(df, ["id"], "v", forms).collect()}
    assert got == {(0, 1), (3, 2), (8, 1)}


def test_full_width_and_empty_tables(spark, forms):
    df = spark.createDataFrame([(0, "ｃol. ２")], "id int, v string")
    assert [r["form_id"] for r in L.disguised(df, ["id"], "v", forms).collect()] == [3]
    assert L.disguised(df.limit(0), ["id"], "v", forms).count() == 0
    assert L.disguised(df, ["id"], "v", forms.limit(0)).count() == 0


def test_regularise_gives_form_or_text(spark, forms):
    df = spark.createDataFrame([(0, "ὄνoμα", "x"), (1, "ἄλλo", "y"), (2, None, "z")], "id int, v string, looks string")
    got = {r["id"]: (r["known"], r["looks"]) for r in L.regularise(df, ["id"], "v", forms).collect()}
    assert got[0][0] == "ὄνομα" and got[1] == (None, "ἄλλο") and got[2] == (None, None)


def test_compatibility_forms(spark):
    pairs = [("𝐚𝐛", "ab"), ("ϕϑϐϰ", "φθβκ"), ("ｱﾞ", "ア゛".replace("゛", "゙")), ("ℓ", "l"), ("㎏", "kg"), ("ﬆ", "st"), ("𝛼", "α"), ("Ⅻ", "XII"), ("…", "..."), ("ﻻ", "لا")]
    assert looks(spark, [a for a, _ in pairs]) == looks(spark, [b for _, b in pairs])
    # of another look: not the same unless asked for
    raised = ["x²", "①", "ⁿ", "½", "H₂"]
    assert looks(spark, raised) != looks(spark, ["x2", "1", "n", "1⁄2", "H2"])
    df = spark.createDataFrame(list(enumerate(raised)), "id int, v string")
    assert [r["looks"] for r in L.canonical(df, ["id"], "v", "looks", loose=True).orderBy("id").collect()] == looks(spark, ["x2", "1", "n", "1⁄2", "H2"])
    apart = looks(spark, ["ϲ", "ς", "Ϲ", "Σ", "ſ", "s", "ϖ", "π", "¨", "´"])
    assert len(set(apart)) == len(apart)
