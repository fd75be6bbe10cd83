"""Tool names: qualification, splitting, words, globs and behaviour hints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden.constants import MISSING_TOOL, QUALIFIER
from callwarden.functions.base import all_of, col, is_true

HINTS = ["read_only", "destructive", "idempotent", "open_world"]


def qualify(server: Column | str, tool: Column | str) -> Column:
    """`server__tool`."""
    return F.concat_ws(QUALIFIER, col(server), col(tool))


def split_tool(name: Column | str) -> Column:
    """Split on the first `__`; NULL when either part would be empty."""
    name = col(name)
    at = F.instr(name, QUALIFIER)
    tool = F.substring(name, at + 2, F.length(name))
    return F.when(
        (at > 1) & (F.length(tool) > 0),
        F.struct(F.substring(name, F.lit(1), at - 1).alias("server"), tool.alias("tool")),
    )


def tool_or_missing(name: Column | str) -> Column:
    return F.coalesce(col(name), F.lit(MISSING_TOOL))


def effective_hints(hints: Column | str) -> Column:
    """Protocol defaults for undeclared hints; a read-only tool is never destructive."""
    h = col(hints)
    read_only = F.coalesce(h["read_only"], F.lit(False))
    return F.struct(
        read_only.alias("read_only"),
        (~read_only & F.coalesce(h["destructive"], F.lit(True))).alias("destructive"),
        F.coalesce(h["idempotent"], F.lit(False)).alias("idempotent"),
        F.coalesce(h["open_world"], F.lit(True)).alias("open_world"),
    )


def hints_match(hints: Column, wanted: dict[str, bool]) -> Column:
    return all_of(hints[name] == F.lit(value) for name, value in wanted.items())


def name_words(name: Column | str) -> Column:
    """Lower-case words of a name, cut at punctuation and at camel-case humps.

    Only `_ - .` and the space are trimmed: another leading separator stays on its word.
    """
    pieces = F.split(col(name), r"(?=[^\p{L}\p{Nd}])|(?<=\p{Ll})(?=\p{Lu})")
    trimmed = F.transform(pieces, lambda p: F.lower(F.btrim(p, F.lit("_-. "))))
    return F.filter(trimmed, lambda w: F.length(w) > 0)


def glob_regex(pattern: str) -> str:
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return r"\A(?s:" + body + r")\z"


def glob_match(value: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """`*` and `?` glob, compiled by shape so that most patterns stay plain string tests.

    NULL values never match.  SQL LIKE is not used: `_` is common in tool names.
    """
    value = col(value)
    if ignore_case:
        value, pattern = F.upper(value), pattern.upper()
    core = pattern.strip("*")
    if "*" not in pattern and "?" not in pattern:
        test = value == F.lit(pattern)
    elif core == "":
        test = value.isNotNull()
    elif "*" in core or "?" in core:
        test = value.rlike(glob_regex(pattern))
    elif pattern.startswith("*") and pattern.endswith("*"):
        test = value.contains(core)
    elif pattern.endswith("*"):
        test = value.startswith(core)
    else:
        test = value.endswith(core)
    return is_true(test)


def glob_shape(pattern: Column | str) -> Column:
    """The same compilation for patterns held in a table: struct<shape, text>."""
    p = col(pattern)
    core = F.btrim(p, F.lit("*"))
    escaped = F.regexp_replace(p, r"([\\.\[\]{}()+^$|\-])", r"\\$1")
    regex = F.concat(
        F.lit(r"\A(?s:"),
        F.regexp_replace(F.regexp_replace(escaped, r"\?", "."), r"\*", ".*"),
        F.lit(r")\z"),
    )
    shape = (
        F.when(p.isNull(), F.lit("any"))
        .when(~p.rlike(r"[*?]"), F.lit("equals"))
        .when(F.length(core) == 0, F.when(p.contains("?"), F.lit("regex")).otherwise(F.lit("present")))
        .when(core.rlike(r"[*?]"), F.lit("regex"))
        .when(p.startswith("*") & p.endswith("*"), F.lit("contains"))
        .when(p.endswith("*"), F.lit("prefix"))
        .otherwise(F.lit("suffix"))
    )
    return F.struct(
        shape.alias("shape"),
        F.when(shape == "equals", p).when(shape == "regex", regex).otherwise(core).alias("text"),
    )


def glob_shape_match(value: Column, glob: Column) -> Column:
    """Match `value` against a compiled `glob_shape` struct; `any` matches NULL as well."""
    shape, text = glob["shape"], glob["text"]
    test = (
        F.when(shape == "any", F.lit(True))
        .when(value.isNull(), F.lit(False))
        .when(shape == "present", F.lit(True))
        .when(shape == "equals", value == text)
        .when(shape == "prefix", F.startswith(value, text))
        .when(shape == "suffix", F.endswith(value, text))
        .when(shape == "contains", F.contains(value, text))
        .otherwise(F.rlike(value, text))
    )
    return is_true(test)
