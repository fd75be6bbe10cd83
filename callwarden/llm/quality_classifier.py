"""Quality scores by logistic regression over hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm import ftrl
from callwarden.llm.toxicity import is_held_out

SETTINGS = ftrl.Settings(orders=(1, 2, 3), ditto=True, alpha=0.3, l1=4.0, epochs=4)


def score_quality(docs: DataFrame, labels: DataFrame, settings: ftrl.Settings = SETTINGS, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, held_out, score, predicted) per row of `docs`.

    Labels of held-out keys (crc32 of the key modulo 3 is 1) are not learnt from.  Null and empty
    texts get the bias alone; repeated rows get equal scores; an empty table gives no rows and
    without labels every score is a half; other columns are ignored.  Runs actions.
    """
    known = labels.where(~is_held_out(labels[key], 3, 1))
    weights = ftrl.train(docs, known, settings, key, text, label)
    scored = ftrl.score(docs, weights, settings, key, text)
    return scored.select(
        F.col("key").alias(key), is_held_out(F.col("key"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, settings: ftrl.Settings = SETTINGS, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of `docs` that score at least `threshold`; learns as `score_quality`.  Runs actions."""
    known = labels.where(~is_held_out(labels[key], 3, 1))
    weights = ftrl.train(docs, known, settings, key, text, label)
    if not weights.any():  # nothing to judge by
        return docs
    kept = ftrl.with_score(docs, weights, settings, text, "quality_score_of_text")
    return kept.where(F.col("quality_score_of_text") >= threshold).select(*docs.columns)
