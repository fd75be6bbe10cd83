"""What costly work is dealt to, how often it is done, and what a walk over JSON carries along."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from callwarden.functions import jsonx
from callwarden.operators.arguments import scan_arguments
from callwarden.plans import inputs

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("table", sorted(inputs.COSTLY))
def test_costly_rows_are_dealt_out(spark, table):
    """One small file is no single task, and no row is lost or doubled."""
    got, given = inputs.load(spark, SF, table), spark.read.parquet(f"{SF}/{table}.parquet")
    assert got.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert got.exceptAll(given).count() == 0 and got.count() == given.count()


def test_texts_are_redacted_once(spark):
    assert plan(entry.queries()["secret_counts"](spark, SF)).count("regexp_replace") == 7


def test_the_log_is_written_and_parsed_once(spark):
    text = plan(entry.queries()["audit_records"](spark, SF))
    assert text.count("from_json(") == 1


def leaves(value, path="$"):
    kids = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in kids:
        here = f"{path}.{k}" if isinstance(k, str) else f"{path}[{k}]"
        form = "o:" if isinstance(v, dict) else "a:" if isinstance(v, list) else f"s:{v}" if isinstance(v, str) else "z:" if v is None else f"b:{str(v).lower()}" if isinstance(v, bool) else f"n:{v}"
        yield here, form
        yield from leaves(v, here)


def deep(n):
    value = "end"
    for i in range(n):
        value = {"k": value} if i % 3 else [value, []]
    return {"a": value, "z": {}}


VALUES = [{}, {"a": 1}, {"a": [], "b": {}}, {"a": "]]}}[[{{\\\"["}, {"a": [[i, {"b": [None, True]}] for i in range(50)]}, deep(5), deep(40), deep(70)]


def test_siblings_are_no_levels(spark):
    values = [*VALUES, {"a": [[] for _ in range(2000)]}, {"a": '["[[[[[["\\'}]
    depth = lambda v: 1 + max((depth(x) for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, dict | list)), default=0)
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", jsonx.nesting(F.col("t")).alias("n")).collect()}
    assert all(depth(v) <= got[i] <= max(4, depth(v)) for i, v in enumerate(values))


def test_leaves_of_wide_and_deep_values(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, t string")
    found = rows.select("i", jsonx.json_leaves(F.try_parse_json("t"), F.col("t")).alias("n")).collect()
    assert {r.i: [(n.path, n.value) for n in r.n] for r in found} == {i: sorted(leaves(v)) for i, v in enumerate(VALUES)}


def test_shell_tools_make_commands_of_all_strings(spark):
    calls = spark.createDataFrame(
        [("srv__exec-tool", '{"note": ["a;b", {"x": "c"}]}'), ("srv__read", '{"note": ["a;b"]}'), ("srv__read", '{"n": {"cmd": ["a;b"]}}')], "tool string, arguments string"
    )
    got = [[(h.detector, h.argument) for h in r.argument_hits] for r in scan_arguments(calls).collect()]
    assert got == [[("shell-metachar", "note[0]")], [], [("shell-metachar", "n.cmd[0]")]]
