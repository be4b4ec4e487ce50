import json
import random

from lexiloom.operators import nested as N
from lexiloom.plans import data_queries


def walk(v, p, out):
    if isinstance(v, dict):
        out.append(p)
        for k, x in v.items():
            walk(x, f"{p}.{k}", out)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            walk(x, f"{p}[{i}]", out)
    return out


def paths(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, f string, path string")
    out = {}
    for r in N.json_objects(df, ["id"], "f").collect():
        out.setdefault(r["id"], []).append((r["node_path"], r["parent_path"], r["kind"], r["ordinal"]))
    return out


def test_places_and_parents(spark):
    got = paths(spark, ['[{"a":[{"b":{}} ,null,{"b":1}]}, null, [[{"c":2}]]]'])[0]
    assert sorted(got) == sorted([
        ("f[0]", None, "f", 0), ("f[0].a[0]", "f[0]", "a", 0), ("f[0].a[0].b", "f[0].a[0]", "b", None), ("f[0].a[2]", "f[0]", "a", 2), ("f[2][0][0]", None, "f", 0),
    ])


def test_broken_scalar_and_encoded(spark):
    inner = json.dumps({"x": [{"y": 'q"]}{'}]})
    texts = [None, "", "null", "3", '"text"', '{"a":1', '{"a":1} x', '{"a":1}{"b":2}', "[]", json.dumps(inner), json.dumps(json.dumps(inner)), json.dumps('{"cut":'), " {} "]
    got = paths(spark, texts)
    assert set(got) == {9, 10, 12}
    often, text = [], inner
    for _ in range(14):
        text = json.dumps(text)
        often.append(text)
    sealed = ['{"a":1}] [', '{"a":1}, 5] [', '"{\\"a\\":1}" x', '{"a":1},{"b":2}', "[1,2] 3"]
    got2 = paths(spark, often + sealed)
    assert set(got2) == set(range(14)) and all([p for p, *_ in v] == ["f", "f.x[0]"] for v in got2.values())
    assert [p for p, *_ in got[9]] == ["f", "f.x[0]"] == [p for p, *_ in got[10]]
    assert got[12] == [("f", None, "f", None)]


def test_random_documents(spark):
    rng = random.Random(9)

    def make(d):
        k = rng.random()
        if d == 0 or k < 0.25:
            return rng.choice([None, 1, 2.5, True, "s[{", "ü\n\\"])
        if k < 0.6:
            return {rng.choice("abcdef") + str(i): make(d - 1) for i in range(rng.randint(0, 3))}
        return [make(d - 1) for _ in range(rng.randint(0, 3))]

    docs = [make(7) for _ in range(120)]
    got = paths(spark, [json.dumps(x, ensure_ascii=rng.random() < 0.5) for x in docs])
    for i, x in enumerate(docs):
        assert sorted(p for p, *_ in got.get(i, [])) == sorted(walk(x, "f", []))


def test_deep_wide_and_repeated_keys(spark):
    deep = '{"a":' * 60 + "1" + "}" * 60
    wide = "[" + ",".join('{"k":"' + "long " * 20 + '"}' for _ in range(3000)) + "]"
    got = paths(spark, [deep, wide, '{"a":{"x":1},"a":{"y":{}}}'])
    assert len(got[0]) == 60 and len(got[1]) == 3000
    assert [p for p, *_ in got[2]] == ["f", "f.a", "f.a.y"]


def test_flat_table_types(spark):
    df = spark.createDataFrame([(1, '[{"w":"x","n":"5"},{"w":{"o":1},"n":7},{}]')], "id int, f string")
    got = sorted((r["node_path"], r["w"], r["n"]) for r in N.flat_table(df, ["id"], "f", "f", {"w": "string", "n": "int"}).collect())
    assert [(p, n) for p, _, n in got] == [("f[0]", 5), ("f[1]", 7), ("f[2]", None)]
    assert N.flat_table(df.limit(0), ["id"], "f", "f", {"w": "string"}).count() == 0


def test_values_are_rows(spark):
    df = spark.createDataFrame([(1, '{"d":["x",{"id":"y"},null,[2.5]],"c":"plain","e":[]}')], "id int, f string")
    got = sorted((r["node_path"], r["parent_path"], r["kind"], r["ordinal"], r["value"]) for r in N.json_values(df, ["id"], "f").collect())
    assert got == [
        ("f.c", "f", "c", None, "plain"), ("f.d[0]", "f", "d", 0, "x"), ("f.d[1].id", "f.d[1]", "id", None, "y"), ("f.d[2]", "f", "d", 2, None), ("f.d[3][0]", "f", "d", 0, "2.5"),
    ]


def test_flat_tables_hold_every_object(spark, tmp_path):
    rules = '[{"form":"a","dialects":["x",{"id":"y"}],"hand":{"scribe":{"new":{"q":1}}},"note":{"text":"t"}}]', '{"context":{"after":{"class":"v"}}}'
    spark.createDataFrame([(1, *rules)], "row_id long, variants string, transformation string").write.parquet(f"{tmp_path}/buck_rules.parquet")
    spark.createDataFrame([(2, '{"note":{"by":{"editor":"e"}}}')], "entry_id long, buck_ref string").write.parquet(f"{tmp_path}/buck_glossary.parquet")
    q = data_queries.QUERIES
    want = sorted((r["row_id"], r["node_path"]) for r in q["p2_found"](spark, str(tmp_path)).collect())
    got = []
    for name in ("p2_other", *[f"p2_{k}" for k in (*data_queries.TOP, *data_queries.KINDS)]):
        got += [(r[0] if name != "p2_other" else r["row_id"], r["node_path"]) for r in q[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == want
    assert {r["node_path"] for r in q["p2_other"](spark, str(tmp_path)).collect()} == {"variants[0].hand.scribe.new", "variants[0].note"}
