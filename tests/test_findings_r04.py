"""Tests of the finding of round 4: each way of reading and writing layers gives what the dearest one gives."""

from pyspark.sql import functions as F

from rasterloom.operators import settings_json as sj
from rasterloom.plans import json_queries
from rasterloom.plans.queries import QUERIES

_X = '{"id":"a/b","name":"n","enabled":true,"polygonVertices":[{"x":1.5},{"y":"2"}],"brushStrokes":[{"r":3,"er":true}],"lumaMax":0.25,"adjustments":{"exposureEV":-2}}'


def _read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return sj.written_layers(sj.read_layers(df, "t", "l"), "l", "j").withColumn("slow", F.expr(sj.write_layers("l"))).orderBy("k").collect()


def test_layers_are_read_and_written_at_once(spark, sf_dir):
    plan = QUERIES["k09_layers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    assert any("_typed" in line and "from_json(ArrayType(StructType(StructField(id,StringType" in line for line in lines)
    assert any("_json" in line and "StructsToJson" in line for line in lines)
    first = sj.written_layers(sj.read_layers(json_queries.texts(spark, sf_dir, json_queries.LAYERS_TEXT), "t", "l"), "l", "j")
    assert first.agg(F.sum(F.expr(f"CAST(NOT j <=> {sj.write_layers('l')} AS INT)"))).first()[0] == 0


def test_ways_of_reading_layers(spark):
    """The same layers with a value that leads to another way; and texts whose whole reading at once would be wrong."""
    full = _read(spark, [f"[{_X}]"])[0].j
    odd = [f"[{_X}]", full, full.replace('"name":"n"', '"name":"\\u006e"'), full.replace('"id"', '"zz":1,"id"', 1), f"[{_X}".replace(",", " , ") + ' , "x"]', full.replace('"', "'")]
    got = _read(spark, odd)
    assert len({str(r.l) for r in got}) == 1 and all(r.j == r.slow == full for r in got)
    one = full[1:-1]
    cases = {
        one: [],  # no list
        f"[{one}": [],
        f"[{one},3,{one}]": ["a/b"],
        f'[{one}," {{}} ",{one}]': ["a/b", "mask-1", "a/b"],
        '[{"id":null,"name":null},{"name":":null"}]': ["null", "mask-1"],
        '[{"id":"a","id":"b"}]': ["a"],
        '[{"id":{"x":null}}]': ['{"x":null}'],
        '[{"id":"a"},{"polygonVertices":null},{"id":"c"}]': ["a"],
        '[{"id":"a"},{"brushStrokes":[1]}]': ["a"],
        full.replace('"id":"a\\/b"', '"id":"a","id":"b"'): ["a"],
        full.replace('"x":0,', ""): ["a/b"],
    }
    got = _read(spark, list(cases))
    assert [[m.id for m in r.l] for r in got] == list(cases.values())
    assert all(r.j == r.slow for r in got)
    assert got[-1].l[0].polygonVertices[1] == (0.0, 2.0)


def test_numbers_that_layers_are_not_written_at_once_with(spark):
    texts = [f'[{{"opacity":{v},"name":"{n}"}}]' for v in ("1e7", "12345678.5", "1e-5", "-0.0", "-0.05", "3.4e39", "16777216", "-3", "0.1") for n in ("n", "v1.0", "a:b", "E1", "NaN")]
    got = _read(spark, texts)
    assert all(r.j == r.slow for r in got) and len({r.j for r in got}) > 30
