"""Injection heuristics and text shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden import constants as C
from callwarden.functions.base import any_of, col, is_true, let, words_regex


def normalise_text(text: Column | str) -> Column:
    """Every run of characters that are not letters or digits becomes one space.

    Padded with a space on both sides, so that whole words can be looked for as ` word `.
    Characters outside the basic plane are separators.  Folding comes before lower-casing.
    """
    padded = F.concat(F.lit(" "), col(text), F.lit(" "))
    return F.lower(F.regexp_replace(padded, r"(?:[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}])+", " "))


def has_hidden_text(text: Column | str) -> Column:
    """Invisible and direction-changing characters; a byte-order mark counts unless it leads."""
    return col(text).rlike(f"[{C.HIDDEN_CHARACTERS}]|(?<=[\\s\\S])\ufeff")


def near_regex(triggers: list[str], targets: list[str], window: int) -> str:
    """A trigger and a target at most `window` words apart, in either order."""
    gap = "(?: [^ ]+){0,%d} " % (window - 1)
    t, g = words_regex(triggers), words_regex(targets)
    return f" (?:{t}){gap}(?:{g}) | (?:{g}){gap}(?:{t}) "


def _phrases(normalised: Column, phrases: list[str]) -> Column:
    return any_of(normalised.contains(f" {p} ") for p in phrases)


def heuristic_flags(text: Column, normalised: Column) -> dict[str, Column]:
    return {
        C.HIDDEN_TEXT: has_hidden_text(text),
        C.ROLE_HIJACK: _phrases(normalised, C.ROLE_HIJACK_PHRASES),
        C.CONCEALMENT: _phrases(normalised, C.CONCEALMENT_PHRASES),
        C.INSTRUCTION_OVERRIDE: normalised.rlike(
            near_regex(C.OVERRIDE_TRIGGERS, C.OVERRIDE_TARGETS, C.OVERRIDE_WINDOW)
        ),
        C.EXFILTRATION: normalised.rlike(
            near_regex(C.EXFILTRATION_TRIGGERS, C.EXFILTRATION_TARGETS, C.EXFILTRATION_WINDOW)
        ),
    }


def scan_text(text: Column | str) -> Column:
    """Ordered array of the heuristics a text trips; empty for NULL and blank text."""
    text = col(text)

    def hits(normalised: Column) -> Column:
        flags = heuristic_flags(text, normalised)
        return F.array_compact(
            F.array(*[F.when(is_true(flags[name]), F.lit(name)) for name in C.HEURISTICS])
        )

    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(text.isNotNull(), let(normalise_text(text), hits)), empty)


def scan_json(text: Column | str) -> Column:
    """Ordered heuristics that the strings of a JSON text trip, names included; empty for text that is not JSON.

    A text is taken apart only if it trips something as a whole or holds an escape: without one its strings stand in it
    as they are, between quotes, which normalise to the spaces that a string is padded with.
    """
    from callwarden.functions import jsonx

    text = col(text)
    found = ordered_union(F.transform(jsonx.json_strings(F.try_parse_json(text), text), scan_text))
    suspect = text.contains("\\") | (F.size(scan_text(text)) > 0)
    return F.coalesce(F.when(suspect, found), F.array().cast("array<string>"))


def ordered_union(arrays: Column) -> Column:
    """Names of an array of arrays in order of first appearance."""
    return F.array_distinct(F.flatten(arrays))


def printable(text: Column | str) -> Column:
    """Control, direction and zero-width characters become `?`."""
    return F.regexp_replace(col(text), f"[{C.UNPRINTABLE}]", "?")


def sample_text(text: Column | str, max_chars: int = C.CLASSIFIER_MAX_CHARS) -> Column:
    """Head and tail of a long text around an omission marker: struct<text, truncated>."""
    text = col(text)
    head, tail = max_chars // 2, max_chars - max_chars // 2
    omitted = (F.length(text) - F.lit(max_chars)).cast("string")
    cut = F.concat(
        F.substring(text, 1, head),
        F.lit("\n[... "), omitted, F.lit(" characters left out ...]\n"),
        F.right(text, F.lit(tail)),
    )
    long = F.length(text) > max_chars
    return F.struct(
        F.when(long, cut).otherwise(text).alias("text"),
        F.coalesce(long, F.lit(False)).alias("truncated"),
    )


def count_of_heuristics(hits: Column) -> Column:
    n = F.size(hits)
    return F.when(n == 1, F.lit("1 prompt-injection heuristic")).otherwise(
        F.concat(n.cast("string"), F.lit(" prompt-injection heuristics"))
    )
