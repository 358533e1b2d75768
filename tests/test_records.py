import json
import random

from pyspark.sql import functions as F

from airlattice.sources import records


def _flat(value, name="", exclude=()):
    """Record by record: (name, leaf) in order."""
    if isinstance(value, dict):
        return [x for k, v in value.items() if k not in exclude for x in _flat(v, f"{name}_{k}" if name else k, exclude)]
    if isinstance(value, list):
        if len(value) == 1:
            return _flat(value[0], name, exclude)
        return [x for i, v in enumerate(value) for x in _flat(v, f"{name}_{i}" if name else str(i), exclude)]
    return [(name, value)]


def _record(rnd, depth):
    kind = rnd.choice("oooaal" if depth else "l")
    if kind == "o":
        return {rnd.choice("abcdefxyz"): _record(rnd, depth - 1) for _ in range(rnd.randrange(4))}
    if kind == "a":
        return [_record(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return rnd.choice([None, 3, -1.5, "word", "", True, 2 ** 60])


def _ordered(value):
    """A VARIANT keeps the fields of an object in the order of their names."""
    if isinstance(value, dict):
        return {k: _ordered(v) for k, v in sorted(value.items())}
    return [_ordered(v) for v in value] if isinstance(value, list) else value


def _maps(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    flat = df.select("id", records.flat_record(F.try_parse_json("j"), **how).alias("m"))
    rows = flat.select("id", F.transform_values("m", lambda k, v: F.to_json(v)).alias("m")).collect()
    return {r.id: r.m and {k: json.loads(v) for k, v in r.m.items()} for r in rows}


def test_records_of_any_shape_match_a_walk(spark):
    rnd = random.Random(4)
    made = [{"a": _record(rnd, 4), "b": _record(rnd, 3), "secret": _record(rnd, 2)} for _ in range(300)]
    got = _maps(spark, [json.dumps(r) for r in made], exclude=["secret"])
    for i, r in enumerate(made):
        want = {}
        for name, leaf in _flat(_ordered(r), exclude=("secret",)):
            want.setdefault(name, leaf)
        assert got[i] == want, (i, r)


def test_awkward_records(spark):
    got = _maps(spark, [None, "no json", "{}", "[]", '{"a":[]}', '{"a":null}', "7", '{"a":{"b":1},"a_b":2}', '[{"a":1},{"a":2}]'])
    assert got[0] is None and got[1] is None
    assert got[2] == got[3] == got[4] == {}
    assert got[5] == {"a": None} and got[6] == {"": 7}
    assert got[7] == {"a_b": 1}                    # the first of two paths of one name
    assert got[8] == {"0_a": 1, "1_a": 2}
    assert _maps(spark, ['{"a":{"b":{"c":1}}}'], depth=2)[0] == {"a_b": {"c": 1}}


def test_wanted_columns_and_types(spark):
    df = spark.createDataFrame([(1, '{"a":{"x":2},"t":"word"}'), (2, '{"a":{"x":"no number"}}'), (3, "broken"), (4, None)], "id long, j string")
    out = records.flatten_records(df, "j", {"a_x": "bigint", "t": "string", "none": "double"}, ["id"])
    assert out.dtypes == [("id", "bigint"), ("a_x", "bigint"), ("t", "string"), ("none", "double")]
    assert sorted(map(tuple, out.collect())) == [(1, 2, "word", None), (2, None, None, None), (3, None, None, None), (4, None, None, None)]


def test_one_scan_without_exchange(spark):
    df = spark.createDataFrame([(1, '{"a":1}')], "id long, j string")
    plan = records.flatten_records(df, "j", {"a": "bigint"}, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
