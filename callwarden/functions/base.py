"""Small helpers shared by the column functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`.

    Column expressions are trees, so a value used five times is written (and, inside
    lambdas, computed) five times.  Binding it as a lambda variable avoids both.
    """
    return F.transform(F.array(value), body).getItem(0)


def any_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else (result | condition)
    return F.lit(False) if result is None else result


def all_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else (result & condition)
    return F.lit(True) if result is None else result


def is_true(condition: Column) -> Column:
    """SQL NULL never counts as a hit."""
    return F.coalesce(condition, F.lit(False))


def strings(values: Iterable[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def char_class(characters: str) -> str:
    """The inside of a regex character class matching exactly these characters."""
    return "".join("\\" + c if c in "\\]^-[&" else c for c in characters)


def words_regex(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed exactly once per row.

    A filter on a plain computed column is pushed below it, which writes the whole expression
    into the filter and computes it (and, say, the JSON parse it reads) again for every
    reference.  A one-element generator is where that stops; it stays inside generated code.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
