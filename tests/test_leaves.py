"""Values of documents by path against a plain walk."""

import datetime
import json
import math
import random

from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import leaves
from riskloom.plans import quality
from riskloom.sources.views import Tables


def plain_field(value, path):
    for part in path.split("."):
        if isinstance(value, list):
            value = value[int(part)] if part.isdigit() and int(part) < len(value) else None
        else:
            value = value.get(part) if isinstance(value, dict) else None
    return value


def random_value(rnd, depth):
    kind = rnd.choice("dlsnifb" if depth else "snifb")
    if kind == "d":
        return {rnd.choice(["a", "b", "list", "x.y", "", "0"]): random_value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))}
    if kind == "l":
        return [random_value(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return {"s": rnd.choice(["text", "", "é \"q\"", "12"]), "n": None, "i": rnd.randint(-5, 10**12), "f": rnd.choice([0.5, 1e-5, 4e-4, 12345678.25, -3.0]), "b": rnd.random() < 0.5}[kind]


def as_text(value):
    return None if value is None else str(value).lower() if isinstance(value, bool) else value if isinstance(value, str) else repr(value)


def test_fields_by_path(spark):
    rnd = random.Random(4)
    docs = [{"root": random_value(rnd, 6)} for _ in range(80)]
    parts = ["root", "a", "b", "list", "0", "1", "2", "x"]
    asked = [(i, ".".join(["root", *(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))])) for i in range(80) for _ in range(20)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{broken")], "id int, doc string")
    found = leaves.values(rows.select("id", F.try_parse_json("doc").alias("doc")), ["id"], "doc")
    got = leaves.at_path(found, spark.createDataFrame(asked + [(900, "root"), (901, "root")], "id int, path string").distinct(), ["id"]).collect()
    for r in got:
        want = plain_field(docs[r.id], r.path) if r.id < 900 else None
        if isinstance(want, (dict, list)):
            assert r.kind in ("object", "list") and json.loads(r.text) == want
        else:
            assert r.text == as_text(want), (r, want)
    assert sum(r.text is not None for r in got) > 50


def test_a_thousand_paths(spark):
    doc = json.dumps({f"k{i}": {"v": i} for i in range(1000)})
    rows = spark.createDataFrame([(i, doc) for i in range(3)], "id int, doc string").select("id", F.try_parse_json("doc").alias("doc"))
    asked = spark.range(1000).select((F.col("id") % 3).cast("int").alias("id"), F.format_string("k%d.v", "id").alias("path"))
    got = leaves.at_path(leaves.values(rows, ["id"], "doc"), asked, ["id"]).collect()
    assert len(got) == 1000 and all(r.path == f"k{r.text}.v" for r in got)


def test_statements(spark):
    row = spark.createDataFrame([(1, ("s", 0.0004, 12345678.5, True, None, datetime.date(2023, 6, 30), ([1, 2], {"deep": (7,)})))], "id int, sheet struct<name:string,pp:double,limit:double,flag:boolean,none:string,as_of_date:date,more:struct<list:array<int>,m:map<string,struct<n:long>>>>")
    got = {r.statement for r in leaves.statements(row.select("id", F.to_variant_object("sheet").alias("sheet")), ["id"], "sheet").collect()}
    assert got == {"name = s.", "pp = 0.0004.", "limit = 12345678.5.", "as_of_date = 2023-06-30.", "more.m.deep.n = 7."}


def test_numbers_are_written_plainly(spark):
    rnd = random.Random(1)
    xs = [0.0, -0.0, 1.0, 5e-324, 1e16, 1e-4, 9e-5, 123456789.125, 1e22, 1.5e-7, 1e100, -2.5e-300, 9999999999999998.0, *(rnd.choice([1, -1]) * math.exp(rnd.uniform(-30, 45)) for _ in range(300))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.number_text(F.col("x")).alias("t")).collect()
    assert all(float(r.t) == r.x for r in got)
    assert all(r.t == repr(r.x) for r in got if abs(r.x) < 2**53 and r.x != 5e-324)  # beyond, this JVM's text isn't always the shortest


def test_a_field_is_reached_without_taking_documents_apart(spark):
    rnd = random.Random(9)
    docs = [{"root": random_value(rnd, 6)} for _ in range(60)]
    parts = ["root", "a", "b", "list", "0", "1", "2", "x", "", "01", "99999999999"]
    asked = [(i, json.dumps(docs[i]), ".".join(["root", *(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))])) for i in range(60) for _ in range(15)]
    asked += [(900, None, "root"), (901, "{broken", "root"), (902, '{"a": 1}', ""), (903, '{"it\'s \\"q\\"": [{"0": 2.50}]}', 'it\'s "q".0.0')]
    rows = spark.createDataFrame(asked, "id int, doc string, path string").withColumn("doc", F.try_parse_json("doc"))
    found = leaves.fields(rows, "doc", "path", "f")
    assert not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join", "Generate"))
    for r in found.select("id", "path", "f.kind", "f.text", "f.number").collect():
        empty = any(p == "" for p in r.path.split("."))
        want = plain_field(docs[r.id], r.path) if r.id < 60 and not empty and not any(p in ("01", "99999999999") for p in r.path.split(".")) else None
        if r.id == 903:
            assert (r.kind, r.text, r.number) == ("number", "2.5", 2.5)
        elif isinstance(want, (dict, list)):
            assert r.kind in ("object", "list") and json.loads(r.text) == want
        else:
            assert r.text == as_text(want), (r, want)


def test_a_field_by_path_is_one_pass(spark, data_dir):
    plan = quality.json_path_field(Tables(spark, data_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
