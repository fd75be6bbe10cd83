"""Toxicity scores by FTRL-proximal logistic regression over word n-grams and skip-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm import ftrl

SETTINGS = ftrl.Settings(orders=(1, 2), skips=(2, 3), lower=True, alpha=0.5, l1=20.0, epochs=6)


def is_held_out(key, divisor: int, rest: int):
    """Whether crc32 of the key as text leaves `rest`; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % divisor == rest, F.lit(True))


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: ftrl.Settings = SETTINGS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) per row of `docs`.

    Labels of held-out keys (crc32 of the key modulo 5 is 0) are not learnt from.  Null and empty
    texts get the bias alone; repeated rows get equal scores; an empty table gives no rows and
    without labels every score is a half; other columns are ignored.  Runs actions.
    """
    known = labels.where(~is_held_out(labels[key], 5, 0))
    weights = ftrl.train(docs, known, settings, key, text, label)
    scored = ftrl.score(docs, weights, settings, key, text)
    return scored.select(
        F.col("key").alias(key), is_held_out(F.col("key"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
