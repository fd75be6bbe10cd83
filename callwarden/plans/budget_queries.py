"""Budgets and approvals over `events` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from callwarden.operators import budgets, joins, policy
from callwarden.operators.budgets import Limits
from callwarden.plans.inputs import load, view, with_views
from callwarden.plans.registry import query

# Charging in order, one call after the other, as a fold over the calls of a scope.
_FOLD = """
SELECT {keys}, unnest(r.log) AS x FROM (
  SELECT {keys}, list_reduce([{{'log': [], 'calls': CAST(0 AS BIGINT), 'spent': CAST(0 AS BIGINT), 'id': CAST(0 AS {id_type}), 'cost': CAST(0 AS BIGINT)}}] || list({{'log': [], 'calls': CAST(0 AS BIGINT),
      'spent': CAST(0 AS BIGINT), 'id': call_id, 'cost': cost}} ORDER BY ts, call_id),
    lambda a, b: {{'log': a.log || [{{'id': b.id, 'refused': CASE WHEN {calls} THEN 'max_calls' WHEN {cost} THEN 'max_cost' END, 'used': CASE WHEN {calls} THEN a.calls ELSE a.spent END}}],
      'calls': a.calls + CASE WHEN {calls} OR {cost} THEN 0 ELSE 1 END, 'spent': a.spent + CASE WHEN {calls} OR {cost} THEN 0 ELSE b.cost END, 'id': b.id, 'cost': b.cost}}) AS r
  FROM {source} GROUP BY {keys}) f"""


def fold_sql(source: str, keys: str, max_calls: int | None = None, max_cost: int | None = None, id_type: str = "BIGINT") -> str:
    """Rows (keys, x.id, x.refused, x.used) of a sequential charge."""
    sql = _FOLD.format(
        source=source, keys=keys, id_type=id_type, calls="false" if max_calls is None else f"a.calls >= {max_calls}",
        cost="false" if max_cost is None else f"b.cost > {max_cost} - a.spent",
    )
    log = f"CAST([] AS STRUCT(id {id_type}, refused VARCHAR, used BIGINT)[])"
    return sql.replace("'log': []", f"'log': {log}")


_CHARGED = "SELECT call_id, ts, user_id, session_id, principal, CAST(k % 6 AS BIGINT) AS cost, CAST(ts AS DATE) AS day, user_id % 10 AS installation, event_type <> 'error' AS chargeable FROM calls"


def _charged(spark, sf):
    return view(spark, sf, "calls").select(
        "call_id", "ts", "user_id", "session_id", "principal", (F.col("k") % 6).alias("cost"), F.to_date("ts").alias("day"),
        (F.col("user_id") % 10).alias("installation"), (F.col("event_type") != "error").alias("chargeable"),
    )


@query(
    "budget_calls",
    with_views(
        f"""
SELECT call_id, rn <= 20 AS allowed FROM (SELECT call_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, call_id) AS rn FROM ({_CHARGED}) c WHERE chargeable) r""",
        "calls",
    ),
)
def budget_calls(spark, sf):
    out = budgets.charge_budget(_charged(spark, sf), Limits("session", ["user_id"], max_calls=20)).where("chargeable")
    return out.select("call_id", F.col("refused").isNull().alias("allowed"))


def _refusals(out):
    return out.where("refused IS NOT NULL").select(
        "call_id", F.col("refused.exceeded").alias("exceeded"), F.col("refused.used").alias("used")
    )


@query(
    "budget_cost",
    with_views(
        f"SELECT x.id AS call_id, x.refused AS exceeded, x.used AS used FROM ({fold_sql(f'({_CHARGED}) c WHERE chargeable', 'user_id', max_cost=70)}) y WHERE x.refused IS NOT NULL",
        "calls",
    ),
)
def budget_cost(spark, sf):
    return _refusals(budgets.charge_budget(_charged(spark, sf), Limits("session", ["user_id"], max_cost=70)))


@query(
    "budget_daily",
    with_views(
        f"SELECT x.id AS call_id, x.refused AS exceeded, x.used AS used FROM ({fold_sql(f'({_CHARGED}) c WHERE chargeable', 'installation, day', max_calls=30, max_cost=60)}) y WHERE x.refused IS NOT NULL",
        "calls",
    ),
)
def budget_daily(spark, sf):
    out = budgets.charge_budget(
        budgets.with_day(_charged(spark, sf)), Limits("daily", ["installation", "day"], max_calls=30, max_cost=60)
    )
    return _refusals(out)


@query(
    "budget_orders",
    f"""
SELECT x.id AS call_id, x.refused AS exceeded, x.used AS used FROM ({fold_sql("(SELECT o_orderkey AS call_id, o_orderdate AS ts, o_custkey % 100 AS scope, CAST(floor(o_totalprice / 50000) AS BIGINT) AS cost FROM orders) o", "scope", max_cost=120)}) y WHERE x.refused IS NOT NULL""",
)
def budget_orders(spark, sf):
    calls = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 100).alias("scope_key"),
        F.floor(F.col("o_totalprice") / 50000).alias("cost"), F.lit(True).alias("chargeable"),
    )
    return _refusals(budgets.charge_budget(calls, Limits("principal", ["scope_key"], max_cost=120)))


@query(
    "budget_spend",
    with_views(
        f"""
SELECT c.user_id, count(*) AS calls, CAST(sum(c.cost) AS BIGINT) AS cost FROM ({_CHARGED}) c
JOIN ({fold_sql(f'({_CHARGED}) c WHERE chargeable', 'user_id', max_cost=70)}) y ON y.x.id = c.call_id WHERE y.x.refused IS NULL GROUP BY c.user_id""",
        "calls",
    ),
)
def budget_spend(spark, sf):
    out = budgets.charge_budget(_charged(spark, sf), Limits("session", ["user_id"], max_cost=70))
    return budgets.spend(out, ["user_id"])


BUDGET_POLICY = {
    "access": {"oauth": {}},
    "rules": [
        {"name": "errors", "match": {"tool": "*__error"}},
        {"name": "views", "match": {"tool": "*__view"}, "decision": "allow", "cost": 3},
    ],
}


@query(
    "budget_gate",
    with_views(
        f"""
SELECT c.call_id, CASE WHEN k % 10 = 9 OR event_type = 'error' THEN 'deny' WHEN NOT resolved THEN 'allow' WHEN c.principal IS NULL THEN 'deny' WHEN y.x.refused IS NOT NULL THEN 'deny' ELSE 'allow' END AS verdict,
  CASE WHEN k % 10 = 9 THEN 'arguments.unreadable' WHEN event_type = 'error' THEN 'errors' WHEN resolved AND c.principal IS NULL THEN 'principal.unidentified' WHEN y.x.refused IS NOT NULL THEN concat('principal.', y.x.refused) WHEN event_type = 'view' THEN 'views' END AS rule,
  CASE WHEN k % 10 = 9 THEN 'scanner' WHEN event_type = 'error' THEN 'policy' WHEN resolved AND c.principal IS NULL THEN 'budget' WHEN y.x.refused IS NOT NULL THEN 'budget' ELSE 'policy' END AS source
FROM (SELECT *, user_id % 5 <> 4 AS resolved FROM calls) c LEFT JOIN ({fold_sql('''(SELECT call_id, ts, principal, CAST(CASE WHEN event_type = 'view' THEN 3 ELSE 1 END AS BIGINT) AS cost FROM calls
  WHERE k % 10 <> 9 AND event_type <> 'error' AND user_id % 5 <> 4 AND principal IS NOT NULL) c''', 'principal', max_calls=150, max_cost=40)}) y ON y.x.id = c.call_id""",
        "calls",
    ),
)
def budget_gate(spark, sf):
    calls = view(spark, sf, "calls").withColumn("resolved", F.col("user_id") % 5 != 4)
    decided = policy.evaluate_policy(calls, BUDGET_POLICY)
    out = budgets.gate_budget(decided, Limits("principal", ["principal"], max_calls=150, max_cost=40))
    return out.select("call_id", "decision.verdict", "decision.rule", "decision.source")


# Both scopes in one fold per installation and day: its three sessions and the day's counters
# are the state.
_STATE = "{'log': CAST([] AS STRUCT(id BIGINT, scope VARCHAR)[]), 's0': CAST(0 AS BIGINT), 's1': CAST(0 AS BIGINT), 's2': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'id': %s, 'cost': %s, 'who': %s}"
_SESSION_OUT = "b.cost > 6 - CASE b.who WHEN 0 THEN a.s0 WHEN 1 THEN a.s1 ELSE a.s2 END"
_DAY_OUT = "(a.n >= 4 OR b.cost > 9 - a.d)"
_IN = f"NOT ({_SESSION_OUT}) AND NOT {_DAY_OUT}"
_TWO = f"""
SELECT y.x.id AS call_id, y.x.scope AS scope FROM (SELECT unnest(r.log) AS x FROM (
  SELECT installation, day, list_reduce([{_STATE % ("CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)", "CAST(0 AS BIGINT)")}]
    || list({_STATE % ("call_id", "cost", "who")} ORDER BY ts, call_id),
    lambda a, b: {{'log': a.log || [{{'id': b.id, 'scope': CASE WHEN {_SESSION_OUT} THEN 'session' WHEN {_DAY_OUT} THEN 'daily' END}}],
      's0': a.s0 + CASE WHEN b.who = 0 AND {_IN} THEN b.cost ELSE 0 END, 's1': a.s1 + CASE WHEN b.who = 1 AND {_IN} THEN b.cost ELSE 0 END,
      's2': a.s2 + CASE WHEN b.who = 2 AND {_IN} THEN b.cost ELSE 0 END, 'd': a.d + CASE WHEN {_IN} THEN b.cost ELSE 0 END,
      'n': a.n + CASE WHEN {_IN} THEN 1 ELSE 0 END, 'id': b.id, 'cost': b.cost, 'who': b.who}}) AS r
  FROM (SELECT call_id, ts, CAST(ts AS DATE) AS day, user_id // 3 AS installation, CAST(user_id % 3 AS BIGINT) AS who, CAST(k % 6 AS BIGINT) AS cost FROM calls) c
  GROUP BY installation, day) f) y WHERE y.x.scope IS NOT NULL"""


@query("budget_two_scopes", with_views(_TWO, "calls"))
def budget_two_scopes(spark, sf):
    calls = view(spark, sf, "calls").select(
        "call_id", "ts", "session_id", (F.col("k") % 6).alias("cost"), F.floor(F.col("user_id") / 3).alias("installation"),
        F.lit(True).alias("chargeable"),
    )
    out = budgets.charge_two_budgets(
        budgets.with_day(calls), Limits("session", ["installation", "session_id"], max_cost=6),
        Limits("daily", ["installation", "day"], max_calls=4, max_cost=9),
    )
    return out.where("refused_scope IS NOT NULL").select("call_id", F.col("refused_scope").alias("scope"))


# --- approvals ---------------------------------------------------------------------------------

APPROVALS = {
    "rules": [
        {"name": "big", "match": {"tool": "*__purchase", "args": [{"path": "$.k", "gt": 40}]}, "decision": "require_approval", "approval": {"timeout_s": 7200, "on_timeout": "allow"}},
        {"name": "buy", "match": {"tool": "*__purchase"}, "decision": "require_approval", "approval": {"timeout_s": 3600, "mode": "webhook"}},
    ]
}


@query(
    "approval_resolve",
    with_views(
        """
WITH unreadable AS (SELECT call_id FROM calls WHERE event_type = 'purchase' AND k % 10 = 9),
asked AS (SELECT call_id, ts, CASE WHEN k % 10 < 8 AND k > 40 THEN 'big' ELSE 'buy' END AS rule FROM calls WHERE event_type = 'purchase' AND k % 10 <> 9),
answers AS (SELECT call_id, ts + to_seconds(CAST(100 * (call_id % 90) AS INT)) AS at, ['approved', 'declined', 'unavailable', 'failed'][1 + call_id % 4] AS outcome FROM asked WHERE call_id % 7 <> 0
  UNION ALL SELECT call_id, ts + to_seconds(CAST(5000 AS INT)), 'approved' FROM asked WHERE call_id % 3 = 0
  UNION ALL SELECT call_id, ts - to_seconds(CAST(10 AS INT)), 'declined' FROM asked),
first AS (SELECT q.call_id, arg_min(a.outcome, a.at) AS outcome FROM asked q JOIN answers a ON a.call_id = q.call_id AND a.at >= q.ts AND a.at <= q.ts + to_seconds(CASE q.rule WHEN 'big' THEN 7200 ELSE 3600 END) GROUP BY q.call_id)
SELECT q.call_id, q.rule, coalesce(outcome, 'timed_out') AS approval, CASE WHEN outcome = 'approved' OR (outcome IS NULL AND rule = 'big') THEN 'allow' ELSE 'deny' END AS verdict,
  CASE WHEN outcome = 'approved' OR (outcome IS NULL AND rule = 'big') THEN 'policy' ELSE 'approval' END AS source
FROM asked q LEFT JOIN first f ON f.call_id = q.call_id
UNION ALL SELECT call_id, 'arguments.unreadable', NULL, 'deny', 'scanner' FROM unreadable""",
        "calls",
    ),
)
def approval_resolve(spark, sf):
    calls = view(spark, sf, "calls").where("event_type = 'purchase'")
    c = F.col("call_id")
    outcome = F.element_at(F.array(*[F.lit(o) for o in ("approved", "declined", "unavailable", "failed")]), (c % 4 + 1).cast("int"))
    shifted = lambda n: F.timestamp_add("SECOND", n, F.col("ts"))
    answers = (
        calls.where(c % 7 != 0).select(c.alias("request_id"), shifted((c % 90 * 100).cast("int")).alias("ts"), outcome.alias("outcome"))
        .unionByName(calls.where(c % 3 == 0).select(c.alias("request_id"), shifted(F.lit(5000)).alias("ts"), F.lit("approved").alias("outcome")))
        .unionByName(calls.select(c.alias("request_id"), shifted(F.lit(-10)).alias("ts"), F.lit("declined").alias("outcome")))
    )
    out = joins.resolve_approvals(policy.evaluate_policy(calls, APPROVALS), answers)
    return out.select(
        "call_id", "decision.rule", F.col("decision.approval_result").alias("approval"), "decision.verdict", "decision.source"
    )
