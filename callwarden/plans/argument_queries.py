"""Argument detectors over `pages` and `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.functions import paths, urls
from callwarden.operators import arguments, policy
from callwarden.plans.inputs import load, view, with_views
from callwarden.plans.registry import query

# Reads the host out of the URL and decides by name and by number, part by part.
_HOST = r"regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)', 1)), '\.+$', '')"
_PART = "(CASE WHEN p LIKE '0x%' THEN CAST(p AS BIGINT) WHEN p LIKE '0_%' THEN {octal} ELSE CAST(p AS BIGINT) END)"
_OCTAL = "list_sum(list_transform(range(length(p)), lambda i: CAST(substr(p, CAST(i AS INT) + 1, 1) AS BIGINT) * CAST(pow(8, length(p) - 1 - i) AS BIGINT)))"
_PARTS = f"list_transform(string_split(h, '.'), lambda p: {_PART.format(octal=_OCTAL)})"
_IP = """CASE len(v) WHEN 1 THEN v[1] WHEN 2 THEN v[1] * 16777216 + v[2] WHEN 3 THEN v[1] * 16777216 + v[2] * 65536 + v[3]
  WHEN 4 THEN v[1] * 16777216 + v[2] * 65536 + v[3] * 256 + v[4] END"""
_NUMERIC = "regexp_matches(h, '^(0x[0-9a-f]+|[0-9]+)(\\.(0x[0-9a-f]+|[0-9]+)){0,3}$')"
_INTERNAL = """(h = 'localhost' OR h LIKE '%.localhost' OR h LIKE '%.internal' OR h = '[::1]'
  OR coalesce(ip // 16777216 IN (0, 10, 127) OR ip // 1048576 = 172 * 16 + 1 OR ip // 65536 IN (192 * 256 + 168, 169 * 256 + 254)
     OR ip // 4194304 = 100 * 4 + 1, false))"""
_URL_ROWS = f"""
SELECT page_id, scheme, h, {_IP} AS ip FROM (SELECT page_id, scheme, h, CASE WHEN {_NUMERIC} THEN {_PARTS} END AS v
  FROM (SELECT page_id, scheme, {_HOST} AS h FROM (SELECT page_id, scheme, url AS u FROM urls) a) b) c"""
_URL_HIT = f"CASE WHEN scheme = 'file' THEN true WHEN lower(scheme) IN ('http', 'https', 'ftp') THEN {_INTERNAL} ELSE false END"


@query("ssrf_urls", with_views(f"SELECT page_id, {_URL_HIT} AS internal, {_URL_HIT} AS internal_in_prose FROM ({_URL_ROWS}) r", "urls"))
def ssrf_urls(spark, sf):
    return view(spark, sf, "urls").select(
        "page_id", urls.has_internal_url("url").alias("internal"), urls.has_internal_url("prose").alias("internal_in_prose")
    )


@query(
    "ipv4_forms",
    """
SELECT event_id, CAST(a * 16777216 + b * 65536 + c * 256 + d AS BIGINT) AS dotted, CAST(a * 16777216 + b * 65536 + c * 256 + d AS BIGINT) AS hexed,
  CAST(a * 16777216 + (b * 65536 + c * 256 + d) AS BIGINT) AS short, a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
    OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) AS internal
FROM (SELECT event_id, CAST([10, 127, 172, 192, 169, 100, 8, 0][1 + event_id % 8] AS BIGINT) AS a, CAST([16, 168, 254, 64, 31, 128, 1][1 + event_id % 7] AS BIGINT) AS b, event_id % 256 AS c, event_id // 256 % 256 AS d FROM events) e""",
)
def ipv4_forms(spark, sf):
    e = F.col("event_id")
    a = F.element_at(F.array(*[F.lit(x) for x in (10, 127, 172, 192, 169, 100, 8, 0)]), (e % 8 + 1).cast("int"))
    b = F.element_at(F.array(*[F.lit(x) for x in (16, 168, 254, 64, 31, 128, 1)]), (e % 7 + 1).cast("int"))
    rows = load(spark, sf, "events").select("event_id", a.alias("a"), b.alias("b"), (e % 256).alias("c"), (F.floor(e / 256) % 256).alias("d"))
    text = lambda c: F.col(c).cast("string")
    dotted = F.concat_ws(".", text("a"), text("b"), text("c"), text("d"))
    hexed = F.concat_ws(".", *[F.concat(F.lit("0X0"), F.hex(c)) for c in ("a", "b", "c", "d")])
    short = F.concat(F.lit("0"), F.conv(text("a"), 10, 8), F.lit("."), (F.col("b") * 65536 + F.col("c") * 256 + F.col("d")).cast("string"))
    return rows.select(
        "event_id", urls.parse_ipv4(dotted).alias("dotted"), urls.parse_ipv4(hexed).alias("hexed"),
        urls.parse_ipv4(short).alias("short"), urls.internal_host(dotted).alias("internal"),
    )


@query(
    "ipv6_hosts",
    """
SELECT event_id, event_id % 8 IN (0, 1, 2, 3, 6) OR (event_id % 8 = 5 AND event_id % 3 = 0) AS internal FROM events""",
)
def ipv6_hosts(spark, sf):
    e = F.col("event_id")
    group = F.lower(F.hex(e % 65536))
    host = (
        F.when(e % 8 == 0, F.concat(F.lit("fe80::"), group)).when(e % 8 == 1, F.concat(F.lit("fd00:1::"), group))
        .when(e % 8 == 2, F.lit("::ffff:192.168.0.9")).when(e % 8 == 3, F.lit("64:ff9b::7f00:1"))
        .when(e % 8 == 4, F.concat(F.lit("2001:db8::"), group))
        .when(e % 8 == 5, F.when(e % 3 == 0, F.lit("2002:a00:1::5")).otherwise(F.lit("2002:808:1::5")))
        .when(e % 8 == 6, F.lit("0:0:0:0:0:0:0:1")).otherwise(F.concat(F.lit("1::2::"), group))
    )
    return load(spark, sf, "events").select("event_id", urls.internal_host(host).alias("internal"))


@query(
    "percent_decoding",
    """
SELECT event_id, concat('a', event_id, ['/', '.', chr(8364), '%zz', '/', '~', chr(92)][1 + event_id % 7], 'b') AS decoded FROM events""",
)
def percent_decoding(spark, sf):
    forms = ["%252f", "%c0%ae", "%E2%82%AC", "%zz", "%u002F", "%25257e", "%C1%9c"]
    e = F.col("event_id")
    escaped = F.concat(
        F.lit("a"), e.cast("string"), F.element_at(F.array(*[F.lit(f) for f in forms]), (e % 7 + 1).cast("int")), F.lit("b")
    )
    return load(spark, sf, "events").select("event_id", urls.decode_percent(escaped).alias("decoded"))


@query(
    "host_folding",
    """
SELECT event_id, ['localhost', '127.0.0.1', 'a.b', '10.12', 'plain'][1 + event_id % 5] AS folded FROM events""",
)
def host_folding(spark, sf):
    forms = ["ⓛｏcalⓗost", "①②⑦.₀。⁰．¹", "a․b", "⑩.\U0001d7cf\U0001d7d0", "plain"]
    e = F.col("event_id")
    return load(spark, sf, "events").select(
        "event_id", urls.fold_host(F.element_at(F.array(*[F.lit(f) for f in forms]), (e % 5 + 1).cast("int"))).alias("folded")
    )


# What each value of `commands` trips, by its kind; kind 2 is prose, so there the name decides.
_SENSITIVE = "k % 12 IN (0, 5, 9) OR (k % 12 = 2 AND name <> 'filePath')"
_TRAVERSAL = "k % 12 IN (1, 3, 9)"
_SHELL_TOOL = "user_id % 3 <> 1"
_SHELL = f"(({_SHELL_TOOL}) OR name = 'cmd') AND k % 12 IN (2, 8)"


@query(
    "path_hits",
    with_views(
        f"SELECT call_id, {_SENSITIVE} AS sensitive, {_TRAVERSAL} AS traversal, k % 12 IN (2, 8) AS metacharacters, {_SHELL_TOOL} AS shell_tool FROM commands",
        "commands",
    ),
)
def path_hits(spark, sf):
    c = view(spark, sf, "commands")
    return c.select(
        "call_id",
        paths.has_sensitive_path("val", F.col("name") == "filePath", F.lit(False)).alias("sensitive"),
        paths.has_traversal("val").alias("traversal"),
        paths.has_shell_metacharacters("val").alias("metacharacters"),
        paths.is_shell_tool("tool").alias("shell_tool"),
    )


def _calls(spark, sf):
    nested = F.to_json(
        F.struct(F.map_from_arrays(F.array("name"), F.array(F.array(F.lit("fine"), F.col("val")))).alias("a"), F.col("k").alias("b"))
    )
    return view(spark, sf, "commands").withColumn("arguments", nested)


_LABEL = "concat('a.', CASE WHEN name = 'my value' THEN 'property #1' ELSE name END, '[1]')"
_HITS = f"""concat_ws(', ', CASE WHEN k % 12 = 10 THEN concat('ssrf in ''', {_LABEL}, '''') END,
  CASE WHEN {_SENSITIVE} THEN concat('sensitive-path in ''', {_LABEL}, '''') END,
  CASE WHEN {_TRAVERSAL} THEN concat('path-traversal in ''', {_LABEL}, '''') END,
  CASE WHEN {_SHELL} THEN concat('shell-metachar in ''', {_LABEL}, '''') END)"""


@query("argument_scan", with_views(f"SELECT call_id, {_HITS} AS hits FROM commands", "commands"))
def argument_scan(spark, sf):
    out = arguments.scan_arguments(_calls(spark, sf))
    return out.select("call_id", arguments.hits_summary(F.col("argument_hits")).alias("hits"))


@query(
    "argument_rollup",
    with_views(
        f"""
SELECT tool, detector, count(*) AS calls FROM (SELECT tool, unnest([x for x in [CASE WHEN k % 12 = 10 THEN 'ssrf' END,
  CASE WHEN {_SENSITIVE} THEN 'sensitive-path' END, CASE WHEN {_TRAVERSAL} THEN 'path-traversal' END, CASE WHEN {_SHELL} THEN 'shell-metachar' END] if x IS NOT NULL]) AS detector
  FROM commands) u GROUP BY ALL""",
        "commands",
    ),
)
def argument_rollup(spark, sf):
    out = arguments.scan_arguments(_calls(spark, sf))
    return out.select("tool", F.explode("argument_hits.detector").alias("detector")).groupBy("tool", "detector").agg(
        F.count(F.lit(1)).alias("calls")
    )


@query(
    "deep_arguments",
    """
SELECT event_id, event_id % 5 >= 3 AS too_large, event_id % 5 IN (1, 3, 4) AS found FROM events""",
)
def deep_arguments(spark, sf):
    e = F.col("event_id")
    depth = F.element_at(F.array(*[F.lit(x) for x in (1, 60, 63, 64, 70)]), (e % 5 + 1).cast("int"))
    depth = F.when(e % 5 == 3, F.lit(64)).otherwise(depth)
    top = F.when((e % 5).isin(1, 3), F.lit('"x": "file:///etc", ')).otherwise(F.lit(""))
    text = F.concat(F.lit("{"), top, F.lit('"a": '), F.repeat(F.lit("["), depth), F.repeat(F.lit("]"), depth), F.lit("}"))
    calls = load(spark, sf, "events").select(
        "event_id", F.lit("srv__t").alias("tool"),
        F.when(e % 5 < 3, text).when(e % 5 == 3, F.regexp_replace(text, r"\[\]", '[{"z": 1}]'))
        .otherwise(F.regexp_replace(text, r"\[\]", '[{"z": "http://127.0.0.1/"}]')).alias("arguments"),
    )
    hits = F.col("argument_hits.detector")
    return arguments.scan_arguments(calls).select(
        "event_id", F.array_contains(hits, "argument-too-large").alias("too_large"), F.array_contains(hits, "ssrf").alias("found")
    )


SETTINGS = {
    "action": "audit",
    "overrides": [
        {"tool": "srv1__*", "action": "block"},
        {"tool": "*__read_file", "detectors": ["path-traversal"], "action": "approve"},
        {"tool": "srv2__*", "detectors": ["shell-metachar"]},
        {"tool": "srv3__*", "action": "off"},
    ],
}
_SET = """CASE WHEN user_id % 5 = 1 THEN 1 WHEN user_id % 3 = 1 THEN 2 WHEN user_id % 5 = 2 THEN 3 WHEN user_id % 5 = 3 THEN 4 ELSE 0 END"""
_DETECTORS = f"""[x for x in [CASE WHEN k % 12 = 10 AND s < 2 THEN 'ssrf' END, CASE WHEN ({_SENSITIVE}) AND s < 2 THEN 'sensitive-path' END,
  CASE WHEN {_TRAVERSAL} AND s < 3 THEN 'path-traversal' END, CASE WHEN {_SHELL} AND s IN (0, 1, 3) THEN 'shell-metachar' END] if x IS NOT NULL]"""


@query(
    "argument_settings",
    with_views(
        f"""
SELECT call_id, CASE s WHEN 1 THEN 'block' WHEN 2 THEN 'approve' WHEN 4 THEN 'off' ELSE 'audit' END AS action,
  CASE s WHEN 2 THEN 'path-traversal' WHEN 3 THEN 'shell-metachar' ELSE 'ssrf,sensitive-path,path-traversal,shell-metachar' END AS detectors
FROM (SELECT *, {_SET} AS s FROM commands) c""",
        "commands",
    ),
)
def argument_settings(spark, sf):
    chosen = arguments.argument_settings("tool", SETTINGS)
    return view(spark, sf, "commands").select(
        "call_id", chosen["action"].alias("action"), F.array_join(chosen["detectors"], ",").alias("detectors")
    )


GATE_POLICY = {"rules": [{"name": "ask-k", "match": {"args": [{"path": "$.b", "gt": 90}]}, "decision": "require_approval"}, {"name": "no-low", "match": {"args": [{"path": "b", "lt": 5}]}}]}


@query(
    "argument_gate",
    with_views(
        f"""
SELECT call_id, array_to_string(d, ',') AS hits, CASE WHEN len(d) = 0 OR k < 5 THEN before WHEN s = 1 THEN 'deny' WHEN s = 2 THEN 'require_approval' ELSE before END AS verdict,
  CASE WHEN len(d) = 0 OR k < 5 THEN rule WHEN s = 1 OR (s = 2 AND k <= 90) THEN concat('arguments.', d[1]) ELSE rule END AS rule,
  CASE WHEN len(d) = 0 OR k < 5 THEN NULL WHEN s = 1 THEN 'blocked' WHEN s = 2 THEN 'approval' ELSE 'audited' END AS action,
  len(d) > 0 AND k >= 5 AND s = 2 AS noted
FROM (SELECT *, {_DETECTORS} AS d, CASE WHEN k > 90 THEN 'require_approval' WHEN k < 5 THEN 'deny' ELSE 'allow' END AS before,
    CASE WHEN k > 90 THEN 'ask-k' WHEN k < 5 THEN 'no-low' END AS rule FROM (SELECT *, {_SET} AS s FROM commands) c) x""",
        "commands",
    ),
)
def argument_gate(spark, sf):
    decided = policy.evaluate_policy(_calls(spark, sf), GATE_POLICY)
    out = arguments.gate_arguments(arguments.scan_arguments(decided, SETTINGS))
    return out.select(
        "call_id", F.array_join("argument_hits.detector", ",").alias("hits"), "decision.verdict", "decision.rule",
        F.col("argument_hits_action").alias("action"), F.col("decision.approval_note").isNotNull().alias("noted"),
    )


@query(
    "quarantined_calls",
    with_views(
        """
SELECT call_id, k % 10 = 9 AS quarantined, CASE WHEN call_id % 50 = 0 THEN '(missing)' ELSE tool END AS tool FROM calls""",
        "calls",
    ),
)
def quarantined_calls(spark, sf):
    from callwarden.sources.io import normalise_calls

    c = view(spark, sf, "calls").withColumn("tool", F.when(F.col("call_id") % 50 != 0, F.col("tool")))
    return normalise_calls(c).select("call_id", "quarantined", "tool")
