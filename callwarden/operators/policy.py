"""First-match-wins policies compiled to Columns, and policies kept in a table."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden import constants as C
from callwarden.functions import jsonx
from callwarden.functions.base import all_of, any_of, computed_once, is_true, strings
from callwarden.functions.names import (
    HINTS,
    effective_hints,
    glob_match,
    glob_shape,
    glob_shape_match,
    hints_match,
)

ALLOW, DENY, REQUIRE_APPROVAL = "allow", "deny", "require_approval"
VERDICTS = [ALLOW, DENY, REQUIRE_APPROVAL]
OPERATORS = ["eq", "in", "gt", "lt", "prefix", "not_prefix", "matches"]
APPROVAL_MODES = ["in_band", "webhook", "local_ui"]
_HINT_KEYS = {
    "readOnlyHint": "read_only",
    "destructiveHint": "destructive",
    "idempotentHint": "idempotent",
    "openWorldHint": "open_world",
}

DECISION_TYPE = (
    "struct<verdict:string,reason:string,rule:string,source:string,cost:bigint,"
    "approval:struct<mode:string,timeout_s:int,on_timeout:string,prompt:string>,"
    "approval_result:string,approval_note:string,trail:array<string>>"
)
HINT_TYPE = "struct<read_only:boolean,destructive:boolean,idempotent:boolean,open_world:boolean>"
DEFAULT_REASON = "Allowed, as no rule applies."


class PolicyError(ValueError):
    """The policy cannot be used as written."""


# --- validation -----------------------------------------------------------------


def _blank(value) -> bool:
    return not isinstance(value, str) or not value.strip()


def _check_predicate(rule: str, predicate: dict) -> None:
    path = predicate.get("path")
    if _blank(path):
        raise PolicyError(f"rule '{rule}': an argument predicate needs a 'path'")
    try:
        jsonx.variant_path(path)
    except jsonx.JsonPathError as error:
        raise PolicyError(f"rule '{rule}': {error}") from error
    unknown = set(predicate) - {"path", *OPERATORS}
    if unknown:
        raise PolicyError(f"rule '{rule}': unknown keys {sorted(unknown)} on '{path}'")
    used = [op for op in OPERATORS if predicate.get(op) is not None]
    if len(used) != 1:
        raise PolicyError(f"rule '{rule}': '{path}' needs exactly one operator, got {used}")
    op, operand = used[0], predicate[used[0]]
    if op in ("prefix", "not_prefix", "matches") and not isinstance(operand, str):
        raise PolicyError(f"rule '{rule}': '{op}' on '{path}' takes a string")
    if op in ("prefix", "not_prefix") and not operand:
        raise PolicyError(f"rule '{rule}': empty '{op}' on '{path}'")
    if op == "in" and not (isinstance(operand, list) and operand):
        raise PolicyError(f"rule '{rule}': 'in' on '{path}' needs a non-empty list")
    if op in ("gt", "lt") and (isinstance(operand, bool) or not isinstance(operand, int | float)):
        raise PolicyError(f"rule '{rule}': '{op}' on '{path}' takes a number")
    if op == "matches":
        try:
            re.compile(operand)
        except re.error as error:
            raise PolicyError(f"rule '{rule}': invalid regular expression on '{path}': {error}") from error


def _check_match(rule: str, match: dict) -> None:
    for key in ("tool", "server", "principal"):
        if match.get(key) is not None and _blank(match[key]):
            raise PolicyError(f"rule '{rule}': empty '{key}'; omit it to match everything")
    groups = match.get("groups")
    if groups is not None and (not groups or any(_blank(g) for g in groups)):
        raise PolicyError(f"rule '{rule}': empty 'groups' list or group name")
    hints = match.get("annotations")
    if hints is not None and (not hints or set(hints) - set(_HINT_KEYS)):
        raise PolicyError(f"rule '{rule}': 'annotations' must name at least one known hint")
    args = match.get("args")
    if args is not None and not args:
        raise PolicyError(f"rule '{rule}': empty 'args' list")
    for predicate in args or []:
        _check_predicate(rule, predicate)


def _check_approval(rule: str, decision: str, approval: dict | None) -> None:
    if approval is None:
        return
    if decision != REQUIRE_APPROVAL:
        raise PolicyError(f"rule '{rule}': 'approval' block on a rule that decides '{decision}'")
    if approval.get("mode", "in_band") not in APPROVAL_MODES:
        raise PolicyError(f"rule '{rule}': unknown approval mode")
    if approval.get("timeout_s") is not None and approval["timeout_s"] <= 0:
        raise PolicyError(f"rule '{rule}': 'timeout_s' must be positive")
    if approval.get("on_timeout", DENY) not in (ALLOW, DENY):
        raise PolicyError(f"rule '{rule}': 'on_timeout' is allow or deny")


def validate_policy(policy: dict) -> dict:
    """Refuse policies that would not do what their author thinks; returns the policy."""
    identity = (policy.get("access") or {}).get("oauth") is not None
    for rule in policy.get("rules") or []:
        name = rule.get("name")
        if _blank(name):
            raise PolicyError("every rule needs a non-empty 'name'")
        decision = rule.get("decision") or DENY
        if decision not in VERDICTS:
            raise PolicyError(f"rule '{name}': unknown decision '{decision}'")
        if (rule.get("cost") or 0) < 0:
            raise PolicyError(f"rule '{name}': negative 'cost'")
        _check_approval(name, decision, rule.get("approval"))
        match = rule.get("match") or {}
        _check_match(name, match)
        if not identity and (match.get("principal") is not None or match.get("groups") is not None):
            raise PolicyError(f"rule '{name}' matches on identity, but 'access.oauth' is not set")
    budgets = policy.get("budgets") or {}
    for scope, limits in budgets.items():
        caps = [(limits or {}).get(k) for k in ("max_calls", "max_cost")]
        if all(c is None for c in caps):
            raise PolicyError(f"'budgets.{scope}' sets no limits")
        if any(c is not None and c < 0 for c in caps):
            raise PolicyError(f"'budgets.{scope}' has a negative limit")
    if budgets.get("session") and budgets.get("principal"):
        raise PolicyError("'budgets.session' and 'budgets.principal' cannot both be set")
    if budgets.get("principal") and not identity:
        raise PolicyError("'budgets.principal' needs 'access.oauth'")
    return policy


# --- predicates -------------------------------------------------------------------


def value_equals(value: Column, expected) -> Column:
    """Same kind and same content; numbers exactly where a decimal can hold them."""
    kind = jsonx.json_kind(value)
    if expected is None:
        return kind == "null"
    if isinstance(expected, bool):
        return (kind == "boolean") & (F.try_variant_get(value, "$", "boolean") == F.lit(expected))
    if isinstance(expected, str):
        return (kind == "string") & (F.try_variant_get(value, "$", "string") == F.lit(expected))
    if isinstance(expected, int | float | Decimal):
        double = F.try_variant_get(value, "$", "double") == F.lit(float(expected))
        exact = Decimal(str(expected))
        scale = max(0, -exact.as_tuple().exponent)
        digits = len(exact.as_tuple().digits)
        if scale <= 18 and digits - scale <= 20:
            decimal = F.try_variant_get(value, "$", "decimal(38,18)") == F.lit(str(exact)).cast("decimal(38,18)")
            return (kind == "number") & double & F.coalesce(decimal, F.lit(True))
        return (kind == "number") & double
    return F.lit(False)


def predicate_state(value: Column, predicate: dict, max_regex_chars: int | None = None) -> Column:
    """1 satisfied, 0 not, 2 undecidable.  An absent value satisfies nothing.

    Regular expressions see whole values; a caller may state a length beyond which a value counts
    as undecidable.
    """
    op = next(o for o in OPERATORS if predicate.get(o) is not None)
    operand = predicate[op]
    kind = jsonx.json_kind(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    if op == "eq":
        holds = value_equals(value, operand)
    elif op == "in":
        holds = any_of(is_true(value_equals(value, o)) for o in operand)
    elif op == "gt":
        holds = (kind == "number") & (number > float(operand))
    elif op == "lt":
        holds = (kind == "number") & (number < float(operand))
    elif op == "prefix":
        holds = (kind == "string") & text.startswith(operand)
    elif op == "not_prefix":
        holds = value.isNotNull() & ((kind != "string") | ~text.startswith(operand))
    else:
        # Unicode classes and case, and only "\n" as a line end.
        holds = (kind == "string") & text.rlike("(?dU)" + operand)
        decided = F.when(is_true(holds), F.lit(1)).otherwise(F.lit(0))
        if max_regex_chars is None:
            return decided
        return F.when(is_true((kind == "string") & (F.length(text) > max_regex_chars)), F.lit(2)).otherwise(decided)
    return F.when(is_true(holds), F.lit(1)).otherwise(F.lit(0))


# --- a policy as one Column ---------------------------------------------------------


def _conditions(match: dict, arguments: Column, max_regex_chars: int | None) -> list[tuple[str, Column]]:
    """(name of the condition, 1 held / 0 failed / 2 undecidable), cheapest first."""
    flag = lambda c: F.when(is_true(c), F.lit(1)).otherwise(F.lit(0))
    found: list[tuple[str, Column]] = []
    if match.get("tool") is not None:
        found.append(("tool", flag(glob_match("tool", match["tool"]))))
    if match.get("server") is not None:
        found.append(("server", flag(glob_match("server", match["server"]))))
    if match.get("principal") is not None:
        found.append(("principal", flag(glob_match("principal", match["principal"], ignore_case=True))))
    if match.get("groups") is not None:
        found.append(("groups", flag(F.arrays_overlap(F.col("groups"), strings(match["groups"])))))
    if match.get("annotations") is not None:
        wanted = {_HINT_KEYS[k]: v for k, v in match["annotations"].items() if v is not None}
        found.append(("annotations", flag(hints_match(effective_hints("hints"), wanted))))
    for predicate in match.get("args") or []:
        value = jsonx.json_path(arguments, predicate["path"])
        found.append((f"argument {predicate['path']}", predicate_state(value, predicate, max_regex_chars)))
    return found


def _default_message(name: str, decision: str) -> str:
    if decision == DENY:
        return f"Rule '{name}' forbids this call; try something else."
    if decision == REQUIRE_APPROVAL:
        return f"Under rule '{name}' a person has to agree to this call first."
    return f"Rule '{name}' allows this call."


def make_decision(
    verdict: Column | str,
    reason: Column,
    rule: Column,
    source: str = "policy",
    cost: Column | int = 1,
    approval: dict | None = None,
    trail: Column | None = None,
) -> Column:
    null = F.lit(None)
    settings = null
    if approval is not None:
        settings = F.struct(
            F.lit(approval.get("mode") or "in_band").alias("mode"),
            F.lit(approval.get("timeout_s") or C.DEFAULT_APPROVAL_TIMEOUT_S).alias("timeout_s"),
            F.lit(approval.get("on_timeout") or DENY).alias("on_timeout"),
            F.lit(approval.get("prompt")).alias("prompt"),
        )
    return F.struct(
        (F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"),
        reason.alias("reason"),
        rule.alias("rule"),
        F.lit(source).alias("source"),
        (F.lit(cost) if isinstance(cost, int) else cost).alias("cost"),
        settings.alias("approval"),
        null.alias("approval_result"),
        null.alias("approval_note"),
        (null if trail is None else trail).alias("trail"),
    ).cast(DECISION_TYPE)


def refuse(decision: Column, source: str, rule: Column, reason: Column, trail: Column) -> Column:
    """Deny, keeping what the decision already carries (cost, approval, trail)."""
    return (
        decision.withField("verdict", F.lit(DENY))
        .withField("source", F.lit(source))
        .withField("rule", rule)
        .withField("reason", reason)
        .withField("trail", F.concat(decision["trail"], F.array(trail)))
        .cast(DECISION_TYPE)
    )


def with_inputs(calls: DataFrame) -> DataFrame:
    """Add the optional call columns a policy reads and parse the arguments once."""
    types = {
        "server": "string",
        "principal": "string",
        "groups": "array<string>",
        "hints": HINT_TYPE,
        "arguments": "string",
    }
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in calls.columns}
    out = calls.withColumns(missing) if missing else calls
    if "args_v" not in out.columns:
        out = computed_once(out, "args_v", F.try_parse_json("arguments"))
    return out


def unreadable() -> Column:
    """Arguments that are there but are no JSON object with distinct names."""
    shape = F.schema_of_variant(F.col("args_v")).startswith("OBJECT")
    return is_true(F.col("arguments").isNotNull() & F.coalesce(~shape, F.lit(True)))


def _unreadable_decision(trail: Column | None) -> Column:
    text = "No rule could be checked: the arguments are no JSON object, or name a property twice."
    return make_decision(DENY, F.lit(text), F.lit(C.UNREADABLE_RULE), source="scanner", trail=trail)


def policy_column(policy: dict, explain: bool = False, max_regex_chars: int | None = None) -> Column:
    """The decision of a policy as one lazy CASE over its rules; needs `with_inputs` columns."""
    arguments = F.col("args_v")
    decided = None
    trail: list[Column] = []

    def note(line: str) -> Column:
        return F.lit(line)

    def add(condition: Column, decision: Column) -> None:
        nonlocal decided
        decided = F.when(condition, decision) if decided is None else decided.when(condition, decision)

    add(unreadable(), _unreadable_decision(F.array(note("arguments: unreadable -> deny")) if explain else None))
    for rule in policy.get("rules") or []:
        name, decision = rule["name"], rule.get("decision") or DENY
        conditions = _conditions(rule.get("match") or {}, arguments, max_regex_chars)
        cost = 1 if rule.get("cost") is None else rule["cost"]
        so_far = list(trail)

        def lines(last: str) -> Column | None:
            return F.array(*so_far, note(last)) if explain else None

        # An undecidable condition counts only when all conditions before it held.
        for i, (condition, state) in enumerate(conditions if max_regex_chars is not None else []):
            predicate = condition.startswith("argument ")
            if not predicate or "matches" not in _operator_at(rule, i, conditions):
                continue
            before = [s == 1 for _, s in conditions[:i]]
            text = (
                f"Refused, as rule '{name}' cannot be decided: the value for its {condition} condition is too "
                "long. A much shorter value may pass."
            )
            add(
                all_of([*before, state == 2]),
                make_decision(
                    DENY, F.lit(text), F.lit(name), trail=lines(f"rule '{name}': UNDECIDABLE ({condition}) -> deny")
                ),
            )
        add(
            all_of(s == 1 for _, s in conditions),
            make_decision(
                decision,
                F.lit(rule.get("message") or _default_message(name, decision)),
                F.lit(name),
                cost=cost,
                approval=rule.get("approval"),
                trail=lines(f"rule '{name}': MATCHED -> {decision}"),
            ),
        )
        if explain:
            missed = None
            for condition, state in conditions:
                line = F.lit(f"rule '{name}': no match ({condition})")
                missed = F.when(state != 1, line) if missed is None else missed.when(state != 1, line)
            trail.append(F.lit(None).cast("string") if missed is None else missed)
    default = make_decision(
        ALLOW,
        F.lit(DEFAULT_REASON),
        F.lit(None),
        trail=F.array(*trail, note("no rule matched -> default allow")) if explain else None,
    )
    return decided.otherwise(default)


def _operator_at(rule: dict, index: int, conditions: list) -> set[str]:
    args = (rule.get("match") or {}).get("args") or []
    return set(args[index - (len(conditions) - len(args))])


def evaluate_policy(
    calls: DataFrame, policy: dict, explain: bool = False, max_regex_chars: int | None = None
) -> DataFrame:
    """Add the `decision` of the first rule that matches; one projection, no shuffle."""
    validate_policy(policy)
    return computed_once(with_inputs(calls), "decision", policy_column(policy, explain, max_regex_chars))


def refusal_message(decision: Column | str) -> Column:
    """What the model is told about a refused call."""
    d = F.col(decision) if isinstance(decision, str) else decision
    kind = (
        F.when(d["rule"].isNull(), F.lit("policy"))
        .when(d["source"] == "budget", F.concat(F.lit("budget '"), d["rule"], F.lit("'")))
        .when(d["source"] == "approval", F.concat(F.lit("approval for rule '"), d["rule"], F.lit("'")))
        .when(d["source"] == "scanner", F.concat(F.lit("scanner '"), d["rule"], F.lit("'")))
        .otherwise(F.concat(F.lit("policy rule '"), d["rule"], F.lit("'")))
    )
    return F.concat(F.lit("Blocked by guardrails "), kind, F.lit(": "), d["reason"])


# --- policies in a table --------------------------------------------------------------


def rules_table_of(spark, policies: dict[str, dict]) -> DataFrame:
    """The rules of several policies as one table (schema of the `rules` source)."""
    rows = []
    for policy_name, policy in policies.items():
        validate_policy(policy)
        for ordinal, rule in enumerate(policy.get("rules") or []):
            match = rule.get("match") or {}
            hints = {_HINT_KEYS[k]: v for k, v in (match.get("annotations") or {}).items()}
            args = [
                {"path": p["path"], "op": op, "operand": json.dumps(p[op])}
                for p in match.get("args") or []
                for op in OPERATORS
                if p.get(op) is not None
            ]
            rows.append(
                {
                    "policy": policy_name,
                    "ordinal": ordinal,
                    "name": rule["name"],
                    "tool": match.get("tool"),
                    "server": match.get("server"),
                    "principal": match.get("principal"),
                    "groups": match.get("groups"),
                    "annotations": {h: hints.get(h) for h in HINTS} if hints else None,
                    "args": args or None,
                    "decision": rule.get("decision"),
                    "cost": rule.get("cost"),
                    "message": rule.get("message"),
                    "approval": _approval_row(rule.get("approval")),
                }
            )
    return spark.createDataFrame(rows, RULES_SCHEMA)


RULES_SCHEMA = (
    "policy string, ordinal int, name string, tool string, server string, principal string, "
    f"groups array<string>, annotations {HINT_TYPE}, "
    "args array<struct<path:string,op:string,operand:string>>, decision string, cost bigint, message string, "
    "approval struct<mode:string,timeout_s:int,on_timeout:string,prompt:string>"
)


def _approval_row(approval: dict | None) -> dict | None:
    if approval is None:
        return None
    return {
        "mode": approval.get("mode") or "in_band",
        "timeout_s": approval.get("timeout_s") or C.DEFAULT_APPROVAL_TIMEOUT_S,
        "on_timeout": approval.get("on_timeout") or DENY,
        "prompt": approval.get("prompt"),
    }


def _json_equal(value: Column, operand: Column) -> Column:
    return jsonx.normalised_leaf(value) == jsonx.normalised_leaf(operand)


def _table_predicate(arguments: Column, p: Column) -> Column:
    value = F.try_variant_get(arguments, p["path"], "variant")
    kind = jsonx.json_kind(value)
    scalar = ~kind.isin("array", "object")
    operand = F.try_parse_json(p["operand"])
    text, wanted = F.try_variant_get(value, "$", "string"), F.try_variant_get(operand, "$", "string")
    number, bound = F.try_variant_get(value, "$", "double"), F.try_variant_get(operand, "$", "double")
    op = p["op"]
    return is_true(
        F.when(op == "eq", scalar & _json_equal(value, operand))
        .when(
            op == "in",
            scalar & F.exists(F.try_variant_get(operand, "$", "array<variant>"), lambda o: _json_equal(value, o)),
        )
        .when(op == "gt", (kind == "number") & (number > bound))
        .when(op == "lt", (kind == "number") & (number < bound))
        .when(op == "prefix", (kind == "string") & F.startswith(text, wanted))
        .when(op == "not_prefix", value.isNotNull() & ((kind != "string") | ~F.startswith(text, wanted)))
        .when(op == "matches", (kind == "string") & F.rlike(text, F.concat(F.lit("(?dU)"), wanted)))
    )


def evaluate_policies(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """First match per call where every call names its own `policy` (many tenants).

    The rules of a policy are gathered into one ordered array (a policy is a document, so the
    group is small) and met by an equi-join on the policy; the first match is then found
    inside the row, one rule at a time.  Calls are never multiplied by rules.  The `decision` is the
    one that `evaluate_policy` would add: unreadable arguments are refused, messages have defaults.
    """
    kind = "struct<mode:string,timeout_s:int,on_timeout:string,prompt:string>"
    approval = F.col("approval") if "approval" in rules.columns else F.lit(None).cast(kind)
    compiled = rules.select(
        "policy",
        F.struct(
            "ordinal",
            "name",
            glob_shape("tool").alias("tool"),
            glob_shape("server").alias("server"),
            glob_shape(F.upper("principal")).alias("principal"),
            "groups",
            "annotations",
            F.transform(
                "args",
                lambda a: F.struct(
                    F.when(a["path"].startswith("$"), a["path"])
                    .otherwise(F.concat(F.lit("$."), a["path"]))
                    .alias("path"),
                    a["op"].alias("op"),
                    a["operand"].alias("operand"),
                ),
            ).alias("args"),
            F.coalesce("decision", F.lit(DENY)).alias("decision"),
            F.coalesce("cost", F.lit(1)).cast("bigint").alias("cost"),
            "message",
            approval.alias("approval"),
        ).alias("rule"),
    )
    per_policy = compiled.groupBy("policy").agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    joined = with_inputs(calls).join(per_policy, "policy", "left")
    hints = effective_hints("hints")

    def matches(r: Column) -> Column:
        wanted = all_of(
            F.coalesce(r["annotations"][h] == hints[h], F.lit(True)) for h in HINTS
        )
        return (
            glob_shape_match(F.col("tool"), r["tool"])
            & glob_shape_match(F.col("server"), r["server"])
            & glob_shape_match(F.upper(F.col("principal")), r["principal"])
            & (r["groups"].isNull() | is_true(F.arrays_overlap(r["groups"], F.col("groups"))))
            & wanted
            & F.coalesce(F.forall(r["args"], lambda p: _table_predicate(F.col("args_v"), p)), F.lit(True))
        )

    # The fold tests no further rule once one has matched.
    none = F.lit(None).cast("int")
    numbers = F.sequence(F.lit(0), F.size("rules") - 1)
    found = F.aggregate(
        F.when(F.size("rules") > 0, numbers).otherwise(F.array().cast("array<int>")),
        none,
        lambda acc, i: F.when(acc.isNotNull(), acc).when(matches(F.get(F.col("rules"), i)), i),
    )
    first = F.when(F.col("rules").isNotNull(), F.get(F.col("rules"), found))
    r = F.col("_rule")
    by_verdict = F.when(r["decision"] == DENY, F.lit(DENY)).when(r["decision"] == REQUIRE_APPROVAL, F.lit(REQUIRE_APPROVAL)).otherwise(F.lit(ALLOW))
    head, tail = F.lit(""), F.lit("")
    for verdict in VERDICTS:
        before, _, after = _default_message("\x00", verdict).partition("\x00")
        head = F.when(by_verdict == verdict, F.lit(before)).otherwise(head)
        tail = F.when(by_verdict == verdict, F.lit(after)).otherwise(tail)
    null = F.lit(None)
    matched = F.struct(
        r["decision"].alias("verdict"), F.coalesce(r["message"], F.concat(head, r["name"], tail)).alias("reason"), r["name"].alias("rule"),
        F.lit("policy").alias("source"), r["cost"].alias("cost"), r["approval"].alias("approval"),
        null.alias("approval_result"), null.alias("approval_note"), null.alias("trail"),
    ).cast(DECISION_TYPE)
    default = make_decision(ALLOW, F.lit(DEFAULT_REASON), F.lit(None))
    decision = F.when(unreadable(), _unreadable_decision(None)).when(r.isNotNull(), matched).otherwise(default)
    return computed_once(computed_once(joined, "_rule", first), "decision", decision).drop("_rule", "rules")


# --- regression and what-if ---------------------------------------------------------------


def what_if(calls: DataFrame, policy_a: dict, policy_b: dict) -> DataFrame:
    """Calls whose verdict changes when policy A is replaced by policy B; one scan."""
    validate_policy(policy_a)
    validate_policy(policy_b)
    both = computed_once(
        computed_once(with_inputs(calls), "before", policy_column(policy_a)), "after", policy_column(policy_b)
    )
    return both.where(F.col("before.verdict") != F.col("after.verdict"))


def rule_table_problems(rules: DataFrame, placeholder: str = "{{server}}") -> DataFrame:
    """Pack rules that are duplicated, not scoped to the pack's server, or named without it."""
    duplicated = (
        rules.groupBy("policy", "name").count().where("count > 1").select("policy", "name", F.lit("duplicate").alias("problem"))
    )
    unscoped = rules.where(~F.col("server").eqNullSafe(placeholder)).select(
        "policy", "name", F.lit("unscoped").alias("problem")
    )
    fixed = rules.where(~F.col("name").contains(placeholder)).select(
        "policy", "name", F.lit("fixed_name").alias("problem")
    )
    return duplicated.unionByName(unscoped).unionByName(fixed)


def render_pack(rules: DataFrame, assignments: DataFrame, placeholder: str = "{{server}}") -> DataFrame:
    """Pack rules with the server's name filled in, one copy per assigned server."""
    fill = lambda c: F.replace(F.col(c), F.lit(placeholder), F.col("assigned"))
    return (
        rules.join(
            assignments.select(F.col("pack").alias("policy"), F.col("server").alias("assigned")), "policy"
        )
        .withColumns({c: fill(c) for c in ("name", "server", "tool", "message")})
        .withColumn("policy", F.col("assigned"))
        .drop("assigned")
    )
