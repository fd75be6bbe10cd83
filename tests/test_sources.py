"""Readers and writers round trip."""

from pyspark.sql import functions as F

from callwarden.operators import audit, policy
from callwarden.sources import io


def test_calls_and_audit(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    (tmp_path / "calls" / "a.json").write_text(
        '{"call_id":"1","ts":"2024-01-01T00:00:00Z","tool":"a__b","arguments":"{\\"k\\": 1}"}\n'
        '{"call_id":"2","ts":"2024-01-02T00:00:00Z","arguments":"{\\"k\\": 1, \\"k\\": 2}"}\n'
    )
    calls = io.read_calls(spark, str(tmp_path / "calls"))
    assert [(r.tool, r.quarantined) for r in calls.orderBy("call_id").collect()] == [("a__b", False), ("(missing)", True)]
    records = audit.to_audit(policy.evaluate_policy(calls, {}))
    io.write_audit(records, str(tmp_path / "log"))
    back = io.read_audit(spark, str(tmp_path / "log")).orderBy("ts").collect()
    assert [(r.tool, r.decision, r.rule) for r in back] == [("a__b", "allow", None), ("(missing)", "deny", "arguments.unreadable")]


def test_catalog_results_and_pins(spark, tmp_path):
    (tmp_path / "cat.json").write_text(
        '{"server":"s","captured_at":"2024-01-01T00:00:00Z","tools":[{"name":"t","description":"d","inputSchema":{"type":"object"}}]}'
    )
    tool = io.read_catalog(spark, str(tmp_path / "cat.json")).first()
    assert (tool.name, tool.input_schema) == ("t", '{"type":"object"}')
    (tmp_path / "res.json").write_text(
        '{"call_id":"1","content":[{"type":"text","text":"x"},{"type":"image"},{"type":"resource","resource":{"uri":"u","text":"y"}}],"structuredContent":{"a":"b"}}'
    )
    rows = io.read_results(spark, str(tmp_path / "res.json")).orderBy("block_idx").collect()
    assert [(r.kind, r.text) for r in rows] == [("text", "x"), ("image", None), ("resource", "y"), ("structured", None)]
    pins = spark.createDataFrame([("s", "i", "h", None, "t", "x", "d")], "server string, identity string, identity_hint string, pinned_at timestamp, tool string, hash string, definition string")
    io.write_pins(pins, str(tmp_path / "pins"), 1)
    io.write_pins(pins.withColumn("hash", F.lit("y")), str(tmp_path / "pins"), 2)
    assert io.read_pins(spark, str(tmp_path / "pins")).first().hash == "y"
