"""Policies, names, hints and JSON access over calls derived from `events` and `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.functions import jsonx, names
from callwarden.operators import arguments, joins, policy
from callwarden.plans.flows import policy_regression
from callwarden.plans.inputs import load, view, with_views
from callwarden.plans.registry import query

ACCESS = {"oauth": {"issuer": "https://login.example.com"}}

FIRST_MATCH = {
    "rules": [
        {"name": "no-errors", "match": {"tool": "*__error"}, "decision": "deny", "message": "errors are off"},
        {"name": "big-k", "match": {"tool": "srv1__*", "args": [{"path": "$.k", "gt": 80}]}, "decision": "require_approval"},
        {"name": "lucky", "match": {"args": [{"path": "k", "in": [7, 17, 27.0]}]}, "decision": "allow", "cost": 5},
        {"name": "own-space", "match": {"args": [{"path": "$.path", "not_prefix": "/workspace/c"}]}, "cost": 0},
        {"name": "flagged", "match": {"args": [{"path": "$.opt['q.r']", "eq": True}]}, "decision": "allow", "cost": 2},
    ]
}

_FIRST_MATCH_CASE = """
SELECT call_id, tool, k, readable, CASE
    WHEN NOT readable THEN 'arguments.unreadable'
    WHEN event_type = 'error' THEN 'no-errors'
    WHEN tool LIKE 'srv1\\_\\_%' ESCAPE '\\' AND has AND k > 80 THEN 'big-k'
    WHEN has AND k IN (7, 17, 27) THEN 'lucky'
    WHEN has AND event_type <> 'click' THEN 'own-space'
    WHEN has AND k % 2 = 0 THEN 'flagged' END AS rule
FROM (SELECT *, NOT (k % 10 = 9) AS readable, k % 10 < 8 AS has FROM calls) c
"""


@query(
    "policy_first_match",
    with_views(
        f"""
SELECT call_id, CASE rule WHEN 'arguments.unreadable' THEN 'deny' WHEN 'no-errors' THEN 'deny' WHEN 'big-k' THEN 'require_approval'
    WHEN 'lucky' THEN 'allow' WHEN 'own-space' THEN 'deny' ELSE 'allow' END AS verdict, rule,
  CAST(CASE rule WHEN 'lucky' THEN 5 WHEN 'own-space' THEN 0 WHEN 'flagged' THEN 2 ELSE 1 END AS BIGINT) AS cost
FROM ({_FIRST_MATCH_CASE}) r""",
        "calls",
    ),
)
def policy_first_match(spark, sf):
    out = policy.evaluate_policy(view(spark, sf, "calls"), FIRST_MATCH)
    return out.select("call_id", "decision.verdict", "decision.rule", "decision.cost")


@query(
    "decision_reasons",
    with_views(
        f"""
SELECT CASE rule
    WHEN 'arguments.unreadable' THEN 'Blocked by guardrails scanner ''arguments.unreadable'': No rule could be checked: the arguments are no JSON object, or name a property twice.'
    WHEN 'no-errors' THEN 'Blocked by guardrails policy rule ''no-errors'': errors are off'
    WHEN 'big-k' THEN 'Blocked by guardrails policy rule ''big-k'': Under rule ''big-k'' a person has to agree to this call first.'
    ELSE 'Blocked by guardrails policy rule ''own-space'': Rule ''own-space'' forbids this call; try something else.'
    END AS message, count(*) AS calls
FROM ({_FIRST_MATCH_CASE}) r WHERE rule IN ('arguments.unreadable', 'no-errors', 'big-k', 'own-space') GROUP BY ALL""",
        "calls",
    ),
)
def decision_reasons(spark, sf):
    out = policy.evaluate_policy(view(spark, sf, "calls"), FIRST_MATCH).where("decision.verdict <> 'allow'")
    return out.groupBy(policy.refusal_message("decision").alias("message")).agg(F.count(F.lit(1)).alias("calls"))


IDENTITY = {
    "access": ACCESS,
    "rules": [
        {"name": "servers", "match": {"server": "srv?", "tool": "srv3*ew"}, "decision": "deny"},
        {"name": "people", "match": {"principal": "user1*@example.com"}, "decision": "deny"},
        {"name": "ops", "match": {"groups": ["ops", "admin"]}, "decision": "allow"},
        {"name": "middle", "match": {"tool": "*4__s*"}, "decision": "require_approval"},
    ],
}


@query(
    "policy_identity",
    with_views(
        """
SELECT call_id, CASE WHEN k % 10 = 9 THEN 'arguments.unreadable' WHEN user_id % 5 = 3 AND event_type = 'view' THEN 'servers'
  WHEN lower(principal) LIKE 'user1%@example.com' THEN 'people'
  WHEN principal IS NOT NULL AND user_id % 2 = 0 THEN 'ops'
  WHEN user_id % 5 = 4 AND event_type = 'signup' THEN 'middle' END AS rule
FROM calls""",
        "calls",
    ),
)
def policy_identity(spark, sf):
    calls = view(spark, sf, "calls").withColumns(
        {
            "server": names.split_tool("tool")["server"],
            "groups": F.when(
                F.col("principal").isNotNull(),
                F.when(F.col("user_id") % 2 == 0, F.array(F.lit("dev"), F.lit("ops"))).otherwise(F.array(F.lit("guest"))),
            ),
        }
    )
    return policy.evaluate_policy(calls, IDENTITY).select("call_id", "decision.rule")


PREDICATES = {
    "eq_text": {"path": "$.note", "eq": "n7"},
    "eq_null": {"path": "$.note", "eq": None},
    "eq_number": {"path": "$.note", "eq": 11.5},
    "eq_true": {"path": "$.opt['q.r']", "eq": True},
    "in_mixed": {"path": "$.opt.deep[1]", "in": ["v1", "v5", 3]},
    "gt_k": {"path": "k", "gt": 50},
    "gt_text": {"path": "$.path", "gt": 0},
    "lt_note": {"path": "$.note", "lt": 20},
    "prefix_path": {"path": "$.path", "prefix": "/workspace/v"},
    "not_prefix_note": {"path": "$.note", "not_prefix": "n1"},
    "matches_path": {"path": "$['path']", "matches": "^/work.*/1\\d\\.txt$"},
    "missing": {"path": "$.opt.deep[7]", "not_prefix": "x"},
    "items": {"path": "$.opt.deep[0]", "eq": 3},
}


@query(
    "policy_predicates",
    with_views(
        """
SELECT call_id, k % 3 = 1 AND k = 7 AND has AS eq_text, k % 3 = 0 AND has AS eq_null, k % 3 = 2 AND k = 11 AND has AS eq_number,
  k % 2 = 0 AND has AS eq_true, k % 6 IN (1, 5) AND has AS in_mixed, k > 50 AND has AS gt_k, false AS gt_text,
  k % 3 = 2 AND k + 0.5 < 20 AND has AS lt_note, event_type = 'view' AND has AS prefix_path,
  has AND NOT (k % 3 = 1 AND CAST(k AS VARCHAR) LIKE '1%') AS not_prefix_note,
  has AND user_id BETWEEN 10 AND 19 AS matches_path, false AS missing, k % 4 = 3 AND has AS items
FROM (SELECT *, k % 10 < 8 AS has FROM calls) c""",
        "calls",
    ),
)
def policy_predicates(spark, sf):
    calls = policy.with_inputs(view(spark, sf, "calls"))
    arguments_v = F.col("args_v")

    def holds(p):
        value = jsonx.json_path(arguments_v, p["path"])
        if "eq" in p and p["eq"] is None:
            return F.coalesce(policy.value_equals(value, None), F.lit(False))
        return policy.predicate_state(value, p) == 1

    return calls.select("call_id", *[holds(p).alias(n) for n, p in PREDICATES.items()])


@query(
    "policy_explain",
    with_views(
        f"""
SELECT call_id, CASE
  WHEN rule = 'arguments.unreadable' THEN 'arguments: unreadable -> deny'
  ELSE concat_ws(' | ',
    CASE WHEN rule = 'no-errors' THEN 'rule ''no-errors'': MATCHED -> deny' ELSE 'rule ''no-errors'': no match (tool)' END,
    CASE WHEN step >= 2 THEN CASE WHEN rule = 'big-k' THEN 'rule ''big-k'': MATCHED -> require_approval'
      WHEN tool LIKE 'srv1%' THEN 'rule ''big-k'': no match (argument $.k)' ELSE 'rule ''big-k'': no match (tool)' END END,
    CASE WHEN step >= 3 THEN CASE WHEN rule = 'lucky' THEN 'rule ''lucky'': MATCHED -> allow' ELSE 'rule ''lucky'': no match (argument k)' END END,
    CASE WHEN step >= 4 THEN CASE WHEN rule = 'own-space' THEN 'rule ''own-space'': MATCHED -> deny' ELSE 'rule ''own-space'': no match (argument $.path)' END END,
    CASE WHEN step >= 5 THEN CASE WHEN rule = 'flagged' THEN 'rule ''flagged'': MATCHED -> allow' ELSE 'rule ''flagged'': no match (argument $.opt[''q.r''])' END END,
    CASE WHEN step = 6 THEN 'no rule matched -> default allow' END) END AS trail
FROM (SELECT *, CASE rule WHEN 'no-errors' THEN 1 WHEN 'big-k' THEN 2 WHEN 'lucky' THEN 3 WHEN 'own-space' THEN 4 WHEN 'flagged' THEN 5 ELSE 6 END AS step
  FROM ({_FIRST_MATCH_CASE}) r) s""",
        "calls",
    ),
)
def policy_explain(spark, sf):
    out = policy.evaluate_policy(view(spark, sf, "calls"), FIRST_MATCH, explain=True)
    return out.select("call_id", F.array_join("decision.trail", " | ").alias("trail"))


UNDECIDABLE = {
    "rules": [
        {"name": "by-text", "match": {"tool": "doc__*", "args": [{"path": "$.n", "lt": 600}, {"path": "$.text", "matches": "(?i)password"}]}, "decision": "allow", "cost": 3}
    ]
}


@query(
    "policy_undecidable",
    with_views(
        """
SELECT doc_id, CASE WHEN doc_id >= 600 THEN 'allow' WHEN length(text) > 1500 THEN 'deny' ELSE 'allow' END AS verdict,
  CASE WHEN doc_id >= 600 THEN NULL WHEN length(text) > 1500 OR regexp_matches(text, '(?i)password') THEN 'by-text' END AS rule
FROM texts""",
        "texts",
    ),
)
def policy_undecidable(spark, sf):
    calls = view(spark, sf, "texts").select(
        "doc_id", F.lit("doc__read").alias("tool"), F.to_json(F.struct(F.col("doc_id").alias("n"), "text")).alias("arguments")
    )
    out = policy.evaluate_policy(calls, UNDECIDABLE, max_regex_chars=1500)
    return out.select("doc_id", "decision.verdict", "decision.rule")


HINTS = {
    "rules": [
        {"name": "reads", "match": {"annotations": {"readOnlyHint": True}}, "decision": "allow"},
        {"name": "destroys", "match": {"annotations": {"destructiveHint": True, "idempotentHint": False}}, "decision": "require_approval"},
        {"name": "rest", "match": {"annotations": {"openWorldHint": True}}, "decision": "deny"},
    ]
}


def catalog_of(tools):
    """`tools` in catalog form."""
    null = F.lit(None)
    return tools.select(
        "server", "captured_at", "name", "title", "description", "input_schema",
        null.cast("string").alias("output_schema"),
        F.struct(
            null.cast("string").alias("title"),
            F.col("read_only").alias("readOnlyHint"),
            F.col("destructive").alias("destructiveHint"),
            null.cast("boolean").alias("idempotentHint"),
            null.cast("boolean").alias("openWorldHint"),
        ).alias("annotations"),
    )


def tool_of_line():
    """The tool that a row of `lineitem` calls."""
    key = F.col("l_partkey")
    verb = F.when(key % 9 == 0, F.lit("deleteItem")).when(key % 9 == 1, F.lit("set-")).when(key % 9 == 2, F.lit("settings_"))
    return F.concat(F.lit("srv"), key % 5, F.lit("__"), verb.otherwise(F.lit("get_")), key).alias("tool")


def tool_calls(spark, sf):
    """Calls of `lineitem` to the tools of `part`, one per line."""
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tool_of_line())


@query(
    "policy_hints",
    with_views(
        """
SELECT l_partkey, rule, server, resolved, count(*) AS calls FROM (
  SELECT l_partkey, t.server, t.server IS NOT NULL AS resolved,
    CASE WHEN t.read_only THEN 'reads' WHEN coalesce(t.destructive, true) THEN 'destroys' ELSE 'rest' END AS rule
  FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey, server, read_only, destructive FROM tools) t ON l_partkey = p_partkey) x
GROUP BY ALL""",
        "tools",
    ),
)
def policy_hints(spark, sf):
    resolved = joins.resolve_tools(tool_calls(spark, sf), catalog_of(view(spark, sf, "tools")))
    out = policy.evaluate_policy(resolved, HINTS)
    return out.groupBy("l_partkey", F.col("decision.rule").alias("rule"), "server", "resolved").agg(
        F.count(F.lit(1)).alias("calls")
    )


@query(
    "effective_hints",
    with_views(
        """
SELECT server, name, captured_at, coalesce(read_only, false) AS read_only, NOT coalesce(read_only, false) AND coalesce(destructive, true) AS destructive,
  false AS idempotent, true AS open_world FROM tools""",
        "tools",
    ),
)
def effective_hints(spark, sf):
    hints = F.struct(
        "read_only", "destructive", F.lit(None).cast("boolean").alias("idempotent"), F.lit(None).cast("boolean").alias("open_world")
    )
    tools = view(spark, sf, "tools").withColumn("h", hints)
    return tools.select("server", "name", "captured_at", names.effective_hints("h").alias("e")).select(
        "server", "name", "captured_at", "e.*"
    )


TENANTS = {
    "p0": FIRST_MATCH,
    "p1": {"rules": [{"name": "views", "match": {"tool": "*__view"}, "decision": "deny", "cost": 4}, {"name": "small", "match": {"args": [{"path": "$.k", "lt": 30}]}, "decision": "allow", "cost": 0}]},
    "p2": {"access": ACCESS, "rules": [{"name": "who", "match": {"principal": "USER?@*"}, "decision": "deny"}, {"name": "mid", "match": {"tool": "srv*ck", "args": [{"path": "$.path", "matches": "/\\d\\.txt"}]}}]},
}


@query(
    "policies_in_a_table",
    with_views(
        f"""
SELECT c.call_id, concat('p', user_id % 4) AS policy, CASE WHEN c.k % 10 = 9 THEN 'deny'
    WHEN user_id % 4 = 0 THEN CASE f.rule WHEN 'no-errors' THEN 'deny' WHEN 'big-k' THEN 'require_approval' WHEN 'own-space' THEN 'deny' ELSE 'allow' END
    WHEN user_id % 4 = 1 AND event_type = 'view' THEN 'deny'
    WHEN user_id % 4 = 2 AND (regexp_matches(principal, '^User[0-9]@') OR (event_type = 'click' AND c.k % 10 < 8 AND user_id < 10)) THEN 'deny'
    ELSE 'allow' END AS verdict,
  CASE WHEN c.k % 10 = 9 THEN 'arguments.unreadable' WHEN user_id % 4 = 0 THEN f.rule
    WHEN user_id % 4 = 1 THEN CASE WHEN event_type = 'view' THEN 'views' WHEN c.k % 10 < 8 AND c.k < 30 THEN 'small' END
    WHEN user_id % 4 = 2 THEN CASE WHEN regexp_matches(principal, '^User[0-9]@') THEN 'who' WHEN event_type = 'click' AND c.k % 10 < 8 AND user_id < 10 THEN 'mid' END END AS rule
FROM calls c JOIN ({_FIRST_MATCH_CASE}) f ON f.call_id = c.call_id""",
        "calls",
    ),
)
def policies_in_a_table(spark, sf):
    calls = view(spark, sf, "calls").withColumn("policy", F.concat(F.lit("p"), F.col("user_id") % 4))
    out = policy.evaluate_policies(calls, policy.rules_table_of(spark, TENANTS))
    return out.select("call_id", "policy", "decision.verdict", "decision.rule")


OTHER = {"rules": [{"name": "k-cap", "match": {"args": [{"path": "$.k", "gt": 60}]}}, *FIRST_MATCH["rules"][1:3]]}


@query(
    "what_if_diff",
    with_views(
        f"""
SELECT call_id, a AS before, b AS after FROM (
  SELECT call_id, CASE rule WHEN 'arguments.unreadable' THEN 'deny' WHEN 'no-errors' THEN 'deny' WHEN 'big-k' THEN 'require_approval' WHEN 'own-space' THEN 'deny' ELSE 'allow' END AS a,
    CASE WHEN NOT readable THEN 'deny' WHEN k % 10 < 8 AND k > 60 THEN 'deny' ELSE 'allow' END AS b
  FROM ({_FIRST_MATCH_CASE}) r) x WHERE a <> b""",
        "calls",
    ),
)
def what_if_diff(spark, sf):
    out = policy.what_if(view(spark, sf, "calls"), FIRST_MATCH, OTHER)
    return out.select("call_id", F.col("before.verdict").alias("before"), F.col("after.verdict").alias("after"))


REGRESSION = {"rules": [{"name": "no-shell", "match": {"tool": "*__runCommand"}}], "scanners": {"arguments": {"action": "block", "detectors": ["sensitive-path", "path-traversal"]}}}


@query(
    "policy_regression",
    with_views(
        """
SELECT call_id AS case_no, NOT fails AS passed, CASE WHEN fails THEN concat('expected ', expect, ', got ', actual) END AS failure FROM (
  SELECT *, expect <> actual AS fails FROM (
    SELECT call_id, CASE WHEN k % 12 IN (0, 1, 3) THEN 'deny' ELSE 'allow' END AS expect,
      CASE WHEN user_id % 3 = 0 OR k % 12 IN (0, 1, 3, 5) OR k % 12 = 9 THEN 'deny'
           WHEN k % 12 = 2 THEN CASE WHEN user_id % 4 = 1 THEN 'allow' ELSE 'deny' END ELSE 'allow' END AS actual
    FROM commands) a) b""",
        "commands",
    ),
)
def policy_regression_cases(spark, sf):
    c = view(spark, sf, "commands")
    cases = c.select(
        F.col("call_id").alias("case_no"), F.col("tool").alias("call"),
        F.to_json(F.create_map(F.col("name"), F.col("val"))).alias("args"), F.lit(None).cast("string").alias("principal"),
        F.lit(None).cast("array<string>").alias("groups"),
        F.when((F.col("k") % 12).isin(0, 1, 3), F.lit("deny")).otherwise(F.lit("allow")).alias("expect"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("array<string>").alias("argument_hits"),
        F.lit(None).cast("boolean").alias("unknown"),
    )
    tools = c.select("tool").distinct().withColumn("hints", F.lit(None).cast(policy.HINT_TYPE))
    return policy_regression(cases, tools, REGRESSION).select("case_no", "passed", "failure")


@query(
    "tool_names",
    with_views(
        """
SELECT call_id, concat(tool, '__x') AS qualified, split_part(tool, '__', 1) AS server, concat(event_type, '__x') AS downstream,
  true AS no_server, true AS no_tool FROM calls""",
        "calls",
    ),
)
def tool_names(spark, sf):
    c = view(spark, sf, "calls").withColumn("q", names.qualify("tool", F.lit("x")))
    parts = names.split_tool("q")
    return c.select(
        "call_id", F.col("q").alias("qualified"), parts["server"].alias("server"), parts["tool"].alias("downstream"),
        names.split_tool(F.concat(F.lit("__"), "tool")).isNull().alias("no_server"),
        names.split_tool(F.concat("event_type", F.lit("__"))).isNull().alias("no_tool"),
    )


@query(
    "name_words",
    """
SELECT p_partkey, lower(concat(replace(p_name, ' ', '|'), '|type|', p_type, '|', p_partkey, '|x')) AS words FROM part""",
)
def name_words(spark, sf):
    camel = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("Type_"), F.col("p_type"), F.lit("."), F.col("p_partkey"), F.lit(" _x-"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(names.name_words(camel), "|").alias("words"))


@query(
    "json_paths",
    with_views(
        """
SELECT call_id, CASE WHEN has THEN k END AS k, CASE WHEN has THEN k % 4 END AS deep, CASE WHEN has THEN concat('v', k % 6) END AS item,
  CASE WHEN has THEN k % 2 = 0 END AS quoted, has AS note_present, has AND k % 3 = 0 AS note_null, false AS missing_present
FROM (SELECT *, k % 10 < 8 AS has FROM calls) c""",
        "calls",
    ),
)
def json_paths(spark, sf):
    c = policy.with_inputs(view(spark, sf, "calls"))
    at = lambda p: jsonx.json_path("args_v", p)
    return c.select(
        "call_id",
        F.try_variant_get(at("k"), "$", "bigint").alias("k"),
        F.try_variant_get(at("$.opt.deep[0]"), "$", "bigint").alias("deep"),
        F.try_variant_get(at("$.opt.deep[1]"), "$", "string").alias("item"),
        F.try_variant_get(at("$.opt['q.r']"), "$", "boolean").alias("quoted"),
        at("$.note").isNotNull().alias("note_present"),
        F.coalesce(F.is_variant_null(at("$.note")), F.lit(False)).alias("note_null"),
        at("$.opt.none").isNotNull().alias("missing_present"),
    )


@query(
    "json_kinds",
    with_views(
        """
SELECT k_kind, note_kind, opt_kind, deep_kind, flag_kind, none_kind, count(*) AS calls FROM (
  SELECT CASE WHEN has THEN 'number' END AS k_kind, CASE WHEN has THEN CASE k % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'string' ELSE 'number' END END AS note_kind,
    CASE WHEN has THEN 'object' END AS opt_kind, CASE WHEN has THEN 'array' END AS deep_kind, CASE WHEN has THEN 'boolean' END AS flag_kind, CAST(NULL AS VARCHAR) AS none_kind
  FROM (SELECT *, k % 10 < 8 AS has FROM calls) c) x GROUP BY ALL""",
        "calls",
    ),
)
def json_kinds(spark, sf):
    c = policy.with_inputs(view(spark, sf, "calls"))
    kind = lambda p: jsonx.json_kind(jsonx.json_path("args_v", p))
    return c.groupBy(
        kind("k").alias("k_kind"), kind("$.note").alias("note_kind"), kind("$.opt").alias("opt_kind"),
        kind("$.opt.deep").alias("deep_kind"), kind("$.opt['q.r']").alias("flag_kind"), kind("$.none").alias("none_kind"),
    ).agg(F.count(F.lit(1)).alias("calls"))


@query(
    "json_strings",
    with_views(
        """
SELECT call_id, CASE WHEN k % 10 < 8 THEN concat_ws('|', 'k', 'note', CASE WHEN k % 3 = 1 THEN concat('n', k) END, 'opt', 'deep', concat('v', k % 6), 'q.r', 'path',
  concat('/workspace/', event_type, '/', user_id, '.txt')) ELSE '' END AS strings FROM calls""",
        "calls",
    ),
)
def json_strings(spark, sf):
    c = policy.with_inputs(view(spark, sf, "calls"))
    return c.select("call_id", F.array_join(jsonx.json_strings("args_v", F.col("arguments")), "|").alias("strings"))


@query(
    "json_nodes",
    with_views(
        """
SELECT call_id, path, value FROM (
  SELECT call_id, '$.k' AS path, concat('n:', k) AS value FROM c UNION ALL
  SELECT call_id, '$.path', concat('s:/workspace/', event_type, '/', user_id, '.txt') FROM c UNION ALL
  SELECT call_id, '$.note', CASE k % 3 WHEN 0 THEN 'z:' WHEN 1 THEN concat('s:n', k) ELSE concat('n:', k, '.5') END FROM c UNION ALL
  SELECT call_id, '$.opt', 'o:' FROM c UNION ALL SELECT call_id, '$.opt.deep', 'a:' FROM c UNION ALL
  SELECT call_id, '$.opt.deep[0]', concat('n:', k % 4) FROM c UNION ALL SELECT call_id, '$.opt.deep[1]', concat('s:v', k % 6) FROM c UNION ALL
  SELECT call_id, '$.opt[''q.r'']', CASE WHEN k % 2 = 0 THEN 'b:true' ELSE 'b:false' END FROM c) n""".replace(
            "FROM c", "FROM (SELECT * FROM calls WHERE k % 10 < 8) c"
        ),
        "calls",
    ),
)
def json_nodes(spark, sf):
    c = policy.with_inputs(view(spark, sf, "calls"))  # arguments that cannot be read have no nodes
    return c.select("call_id", F.explode(jsonx.json_leaves("args_v", F.col("arguments"))).alias("n")).select(
        "call_id", "n.path", "n.value"
    )


@query(
    "argument_summaries",
    with_views(
        """
SELECT call_id, concat('{"k": "', k, '", "long": "', substr(t, 1, 256), '... (', length(t) - 256, ' more characters)", "note": "say ''hi'' to u@[REDACTED:x]"}') AS summary
FROM (SELECT call_id, k, repeat(concat('ab', k), 90) AS t FROM calls) c""",
        "calls",
    ),
)
def argument_summaries(spark, sf):
    c = view(spark, sf, "calls").select(
        "call_id", "tool",
        F.to_json(
            F.struct(
                "k", F.repeat(F.concat(F.lit("ab"), F.col("k")), F.lit(90)).alias("long"),
                F.lit("say 'hi' to u@[REDACTED:x]").alias("note"),
            )
        ).alias("arguments"),
    )
    return arguments.summarise_arguments(c).select("call_id", F.col("argument_summary").alias("summary"))
