"""Argument scanning and the argument and secrets gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden import constants as C
from callwarden.functions import jsonx, secrets
from callwarden.functions.base import char_class, computed_once, is_true, let, strings
from callwarden.functions.names import glob_match
from callwarden.functions.paths import (
    KEYWORD_REGEX,
    SHELL_REGEX,
    has_sensitive_path,
    has_shell_metacharacters,
    has_traversal,
    is_shell_tool,
)
from callwarden.functions.urls import URL_HINT, has_internal_url
from callwarden.operators.policy import DECISION_TYPE, DENY, REQUIRE_APPROVAL, PolicyError, refuse, with_inputs

HITS_TYPE = "array<struct<detector:string,argument:string>>"
ACTIONS = ["audit", "approve", "block", "off"]


# --- settings ---------------------------------------------------------------------


def validate_argument_settings(settings: dict) -> dict:
    entries = [("arguments", settings)] + [
        (f"arguments.overrides[{i}]", o) for i, o in enumerate(settings.get("overrides") or [])
    ]
    for where, entry in entries:
        if entry.get("action") is not None and entry["action"] not in ACTIONS:
            raise PolicyError(f"'{where}.action' is not one of {ACTIONS}")
        for name in entry.get("detectors") or []:
            if name not in C.DETECTORS:
                raise PolicyError(f"'{where}' lists unknown detector '{name}'")
        if entry is not settings:
            if not (entry.get("tool") or "").strip():
                raise PolicyError(f"'{where}' needs 'tool'")
            if entry.get("action") is None and entry.get("detectors") is None:
                raise PolicyError(f"'{where}' sets neither 'action' nor 'detectors'")
    return settings


def argument_settings(tool: Column | str, settings: dict) -> Column:
    """struct<action, detectors> for a tool: the first override glob wins, unset parts inherit."""
    validate_argument_settings(settings)
    action = settings.get("action") or "audit"
    detectors = C.DETECTORS if settings.get("detectors") is None else settings["detectors"]

    def entry(a: str, d: list[str]) -> Column:
        return F.struct(F.lit(a).alias("action"), strings(d).alias("detectors"))

    chosen = None
    for o in settings.get("overrides") or []:
        part = entry(o.get("action") or action, detectors if o.get("detectors") is None else o["detectors"])
        hit = glob_match(tool, o["tool"])
        chosen = F.when(hit, part) if chosen is None else chosen.when(hit, part)
    default = entry(action, detectors)
    return default if chosen is None else chosen.otherwise(default)


# --- the scan ----------------------------------------------------------------------


def detect(name: str, n: Column) -> Column:
    if name == C.SSRF:
        return has_internal_url(n["text"])
    if name == C.SENSITIVE_PATH:
        return has_sensitive_path(n["text"], n["path_named"], n["command"])
    if name == C.PATH_TRAVERSAL:
        return has_traversal(n["text"])
    return n["command"] & has_shell_metacharacters(n["text"])


def too_large(walk: Column) -> Column:
    return (walk["depth"] > C.MAX_DEPTH) | (walk["values"] > C.MAX_VALUES) | (walk["chars"] > C.MAX_CHARACTERS)


def _first_hit(name: str, texts: Column) -> Column:
    first = F.array_min(
        F.transform(
            F.filter(texts, lambda n: detect(name, n)),
            lambda n: F.struct(n["ord"].alias("ord"), n["label"].alias("label")),
        )
    )
    return let(
        first,
        lambda f: F.when(
            f.isNotNull(), F.struct(F.lit(name).alias("detector"), jsonx.cut_label(f["label"]).alias("argument"))
        ),
    )


def hits_of(walk: Column, enabled: Column | None, detectors: list[str]) -> Column:
    """First hit of each detector in key order, in the fixed reporting order."""
    found, texts = [], walk["texts"]
    for name in C.DETECTORS:
        if name in detectors:
            hit = _first_hit(name, texts)
            found.append(hit if enabled is None else F.when(F.array_contains(enabled, name), hit))
    found.append(
        F.when(too_large(walk), F.struct(F.lit(C.TOO_LARGE).alias("detector"), F.lit("").alias("argument")))
    )
    return F.array_compact(F.array(*found)).cast(HITS_TYPE)


def worth_scanning(text: Column) -> Column:
    """Can any detector fire on these arguments?  One pass over the raw JSON text.

    Every hit needs one of these signs in some string, and strings stand in the text as they
    are or with a backslash; sizes and depths past the limits need a long or bracketed text.
    """
    signs = "|".join(
        [r"\\", URL_HINT, KEYWORD_REGEX, f"[{char_class(C.DOTS)}]{{2}}", SHELL_REGEX]
    )
    return is_true(
        text.rlike(signs) | (F.length(text) > C.MAX_VALUES) | (jsonx.nesting_bound(text) > C.MAX_DEPTH)
    )


def scan_arguments(calls: DataFrame, settings: dict | None = None) -> DataFrame:
    """Add `argument_hits`: what the detectors found in a call's arguments.

    The nested arguments are walked and inspected inside their row, so the scan is a
    projection: no shuffle and no grouping back by call.  Arguments whose text shows none of the
    signs of a hit are not walked at all.
    """
    settings = settings or {}
    chosen = argument_settings("tool", settings)
    wanted = set(C.DETECTORS if settings.get("detectors") is None else settings["detectors"])
    for o in settings.get("overrides") or []:
        wanted |= set(o.get("detectors") or [])
    nothing = F.col("args_v").isNull() | (F.col("_set.action") == "off") | (F.size("_set.detectors") == 0)
    ready = with_inputs(calls).withColumn("_set", chosen)
    walk = jsonx.argument_strings("args_v", F.col("arguments"), is_shell_tool("tool"))
    enabled = F.col("_set.detectors") if settings.get("overrides") else None
    hits = let(walk, lambda w: hits_of(w, enabled, sorted(wanted)))
    none = F.array().cast(HITS_TYPE)
    return (
        computed_once(ready, "argument_hits", F.when(nothing | ~worth_scanning(F.col("arguments")), none).otherwise(hits))
        .withColumn("argument_action", F.col("_set.action"))
        .drop("_set")
    )


def hits_summary(hits: Column) -> Column:
    return F.array_join(
        F.transform(
            hits,
            lambda h: F.when(h["argument"] == "", h["detector"]).otherwise(
                F.concat(h["detector"], F.lit(" in '"), h["argument"], F.lit("'"))
            ),
        ),
        ", ",
    )


def gate_arguments(decided: DataFrame) -> DataFrame:
    """Apply `argument_action` to calls with `argument_hits`; adds `argument_hits_action`.

    A hit on a call that is refused already is only recorded; a call that needs approval
    anyway keeps its rule and gets a note for the reviewer.
    """
    import json

    hits, action, d = F.col("argument_hits"), F.col("argument_action"), F.col("decision")
    words = F.from_json(F.lit(json.dumps(C.DETECTOR_TEXT)), "map<string,string>")
    summary = hits_summary(hits)
    found = F.concat(
        F.array_join(F.transform(hits, lambda h: F.element_at(words, h["detector"])), "; "),
        F.lit(" ("), summary, F.lit(")"),
    )
    rule = F.concat(F.lit(C.ARGUMENTS_RULE_PREFIX), hits[0]["detector"])

    def trail(verdict: str) -> Column:
        return F.concat(F.lit("scanner 'arguments': "), summary, F.lit(f" -> {verdict}"))

    blocked = refuse(
        d,
        "scanner",
        rule,
        F.concat(
            F.lit("Call refused. Found in the arguments: "),
            found,
            F.lit(". The same value in another spelling is refused too; describe the goal to the user and wait for a choice."),
        ),
        trail("deny"),
    )
    noted = d.withField(
        "approval_note",
        F.concat(
            F.lit("Look at the arguments first. Found in them: "),
            found,
            F.lit("."),
        ),
    ).withField("trail", F.concat(d["trail"], F.array(trail("require_approval"))))
    escalated = (
        noted.withField("verdict", F.lit(REQUIRE_APPROVAL))
        .withField(
            "reason",
            F.concat(F.lit("A person decides about this call. Found in the arguments: "), found, F.lit(".")),
        )
        .withField("rule", rule)
        .withField("source", F.lit("scanner"))
    )
    audited = d.withField("trail", F.concat(d["trail"], F.array(trail("audit"))))
    untouched = (F.size(hits) == 0) | (d["verdict"] == DENY) | (action == "off")
    acted = decided.withColumns(
        {
            "argument_hits_action": F.when(untouched, F.lit(None).cast("string"))
            .when(action == "block", F.lit("blocked"))
            .when(action == "approve", F.lit("approval"))
            .otherwise(F.lit("audited")),
        }
    )
    return computed_once(
        acted,
        "decision",
        F.when(untouched, d)
        .when(action == "block", blocked)
        .when((action == "approve") & (d["verdict"] == REQUIRE_APPROVAL), noted.cast(DECISION_TYPE))
        .when(action == "approve", escalated.cast(DECISION_TYPE))
        .otherwise(audited.cast(DECISION_TYPE)),
    )


# --- secrets in arguments -------------------------------------------------------------

SECRET_MODES = ["redact_audit", "redact", "block", "off"]


#: Signs that some secret may be in a JSON text: hints of the patterns, a credential's name, an escape.
_SIGNS = r"(?i)\\|-----BEGIN|eyJ|AKIA|ASIA|gh[pousr]_|github_pat_|@|[0-9]{4}|" + "|".join(C.CREDENTIAL_KEY_WORDS)


def redact_arguments(calls: DataFrame, pii: bool = False) -> DataFrame:
    """Add `arguments_redacted` (compact JSON) and `argument_secrets` (kinds found).

    Strings are masked after JSON decoding.  Whatever hangs under a credential's name, directly or inside
    objects and arrays at any depth, is masked whole: strings, numbers and booleans, unless nothing but one known
    marker is left of it.  Names and structure stay.  Texts without any sign of a secret are not taken apart.
    """
    field, markers = secrets.marker(secrets.SENSITIVE_FIELD), [secrets.marker(k) for k in secrets.patterns(True)]

    redacted = lambda t: F.when(t.rlike(secrets.SIGNS), secrets.redact_text(t, pii)).otherwise(t)

    def string(piece: Column, text: Column, plain: Column, own: Column) -> Column:
        whole = own & (F.length(text) > 0) & ~plain.isin(*markers)
        # a string that nothing was found in stays as it was written
        return F.when(whole & (text != field), F.lit(f'"{field}"')).when(whole | (plain == text), piece).otherwise(jsonx.quoted(plain))

    def change(piece: Column, own: Column) -> Column:
        masked = let(jsonx.unquoted(piece), lambda t: let(redacted(t), lambda plain: string(piece, t, plain, own)))
        other = F.when(own & (piece != "null"), F.lit(f'"{field}"')).otherwise(piece)
        return F.when(piece.startswith('"'), masked).otherwise(other)

    suspect = lambda text: is_true(text.rlike(_SIGNS))
    rewritten = lambda text: jsonx.rewrite_scalars(text, C.CREDENTIAL_KEY_WORDS, secrets.is_credential_key, change)
    masked = let(F.to_json("args_v"), lambda text: F.when(suspect(text), rewritten(text)).otherwise(text))
    out = computed_once(with_inputs(calls), "arguments_redacted", masked)
    return out.withColumn("argument_secrets", secrets.kinds_in_redacted("arguments_redacted", pii))


def gate_secrets(decided: DataFrame, mode: str = "redact_audit") -> DataFrame:
    """Deny calls carrying secrets under `block`; adds `argument_secrets_action`."""
    if mode not in SECRET_MODES:
        raise PolicyError(f"unknown secrets mode '{mode}'")
    d, hits = F.col("decision"), F.col("argument_secrets")
    found = (F.size(hits) > 0) & F.lit(mode != "off")
    block = found & F.lit(mode == "block") & (d["verdict"] != DENY)
    reason = F.concat(
        F.lit("Secrets may not be sent along. Kinds found: "),
        F.array_join(hits, ", "),
        F.lit("."),
    )
    refused = refuse(
        d, "scanner", F.lit(C.SECRETS_RULE), reason,
        F.concat(F.lit("scanner 'secrets': arguments matched "), F.array_join(hits, ", "), F.lit(" -> deny")),
    )
    action = (
        F.when(~found | (d["verdict"] == DENY), F.lit(None).cast("string"))
        .when(F.lit(mode == "block"), F.lit("blocked"))
        .when(F.lit(mode == "redact"), F.lit("redacted"))
        .otherwise(F.lit("forwarded"))
    )
    return computed_once(
        decided.withColumn("argument_secrets_action", action), "decision", F.when(block, refused).otherwise(d)
    )


def result_secrets(results: DataFrame, mode: str = "redact", pii: bool = False) -> DataFrame:
    """Mask (`redact`), withhold (`block`) or pass (`off`) secrets in result text."""
    if mode not in ("redact", "block", "off"):
        raise PolicyError(f"unknown result secrets mode '{mode}'")
    out = computed_once(results, "_red", secrets.redact_text("text", pii)).withColumn(
        "result_secrets", F.coalesce(secrets.kinds_in_redacted("_red", pii), strings([]))
    )
    found = (F.size("result_secrets") > 0) & F.lit(mode != "off")
    text = F.when(~found, F.col("text"))
    text = text.when(
        F.lit(mode == "block"),
        F.concat(
            F.lit("Output removed by the secrets scanner. Kinds found: "),
            F.array_join("result_secrets", ", "),
            F.lit("."),
        ),
    ).otherwise(F.col("_red"))
    action = F.when(found, F.lit("blocked" if mode == "block" else "redacted"))
    return out.withColumns({"text": text, "result_secrets_action": action}).drop("_red")


def summarise_arguments(calls: DataFrame, pii: bool = False) -> DataFrame:
    """Add `argument_summary`: what a reviewer is shown, masked, cut and escaped."""
    cut = C.APPROVAL_ARGUMENT_LENGTH

    def shorten(t: Column) -> Column:
        rest = (F.length(t) - F.lit(cut)).cast("string")
        return F.when(F.length(t) <= cut, t).otherwise(
            F.concat(F.substring(t, 1, cut), F.lit("... ("), rest, F.lit(" more characters)"))
        )

    def escape(t: Column) -> Column:
        quoted = F.to_json(F.struct(t.alias("t")))
        inner = F.substring(quoted, F.lit(7), F.length(quoted) - 8)
        return F.array_join(
            F.transform(
                F.regexp_extract_all(inner, F.lit(r"(?s)\p{Cf}|[^\p{Cf}]+"), F.lit(0)),
                lambda p: F.when(
                    p.rlike(r"^\p{Cf}$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(p)), 4, "0"))
                ).otherwise(p),
            ),
            "",
        )

    def pair(e: Column) -> Column:
        value = F.coalesce(jsonx.as_string(e["value"]), F.to_json(e["value"]))
        name = secrets.redact_text(e["key"], pii)
        return F.concat(F.lit('"'), escape(shorten(name)), F.lit('": "'), escape(shorten(value)), F.lit('"'))

    # Everything shown comes from the masked tree, whatever its depth.
    masked = F.try_parse_json("arguments_redacted")
    pairs = F.transform(F.map_entries(F.try_variant_get(masked, "$", "map<string,variant>")), pair)

    # Take pairs while the whole still fits; everything behind the first misfit is counted.
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("shown"), F.lit(False).alias("full"))

    def take(acc: Column, p: Column) -> Column:
        text = F.concat(acc["text"], F.when(acc["shown"] == 0, F.lit("")).otherwise(F.lit(", ")), p)
        fits = ~acc["full"] & (F.length(text) + 2 <= C.APPROVAL_RENDERED_LENGTH)
        return F.when(
            fits, F.struct(text.alias("text"), (acc["shown"] + 1).alias("shown"), F.lit(False).alias("full"))
        ).otherwise(F.struct(acc["text"].alias("text"), acc["shown"].alias("shown"), F.lit(True).alias("full")))

    hidden = F.size("_pairs") - F.col("_taken.shown")
    rendered = F.concat(F.lit("{"), F.col("_taken.text"), F.lit("}"))
    had = [c for c in ("arguments_redacted", "argument_secrets") if c in calls.columns]
    ready = calls if len(had) == 2 else redact_arguments(calls, pii)
    return (
        ready.withColumn("_pairs", pairs)
        .withColumn("_taken", F.aggregate("_pairs", start, take))
        .withColumn(
            "argument_summary",
            F.when(hidden == 0, rendered).otherwise(
                F.concat(rendered, F.lit(" ("), hidden.cast("string"), F.lit(" more not shown)"))
            ),
        )
        .drop("_pairs", "_taken", *[c for c in ("arguments_redacted", "argument_secrets") if c not in had])
    )
