"""Document quality by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the counts of vote
patterns (at most 3 ** rules rows, whatever the corpus) estimates how good and bad documents vote;
the posterior probability of being good decides, instead of all rules having to pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.llm.arrays import Hasher, blocks, mix, text_bytes, words
from callwarden.llm.storage import keyed_texts, stored

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ditto")

#: With fewer words all rules but the first abstain.
LEAST_WORDS = 20


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _measures(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    docs = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    n_words = np.bincount(doc, minlength=docs)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int32) > 0
    word_chars = _per_doc(inside & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_doc(_SYMBOL[data], offsets)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    hasher = Hasher(data)
    # lines end at line feeds and at the ends of documents
    feeds = np.flatnonzero(data == 10)
    line_ends = np.sort(np.concatenate((feeds, offsets[1:])), kind="stable")
    line_starts = np.sort(np.concatenate((feeds + 1, offsets[:-1])), kind="stable")
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    n_lines = np.bincount(line_doc, minlength=docs)
    line_keys = mix(hasher.ranges(line_starts, line_ends) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(line_keys, return_index=True)
    n_dup_lines = n_lines - np.bincount(line_doc[first], minlength=docs)
    # words in windows that occur twice
    single = hasher.ranges(starts, ends)
    same = np.zeros(len(single), bool)
    same[1:] = (single[1:] == single[:-1]) & (doc[1:] == doc[:-1])
    covered = np.zeros(len(single), bool)
    n = len(single) - WINDOW + 1
    if n > 0:
        h = doc[:n].astype(np.uint64)
        for i in range(WINDOW):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + single[i : i + n])
        valid = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
        keys = h[valid]
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = valid[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
            change = np.zeros(len(single) + 1, np.int32)
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
            covered = np.cumsum(change[:-1]) > 0
    return [
        n_words, word_chars, n_symbols, n_dup_lines, np.bincount(doc[covered], minlength=docs), n_lines,
        _per_doc(upper, offsets), _per_doc(upper | lower | (data >= 0xC0), offsets), np.bincount(doc[same], minlength=docs),
    ]


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the counts of MEASURES) per row; see the query's contract for the first five."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in blocks(offsets):
                found = _measures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(f.astype(np.int64)) for f in found]], ["key", *MEASURES])

    slim = keyed_texts(docs, key, text)
    return slim.mapInArrow(run, f"key {slim.schema['key'].dataType.simpleString()}, " + ", ".join(f"{m} bigint" for m in MEASURES))


def votes() -> dict[str, Column]:
    """The vote of each rule on the measures."""
    n = F.col("n_words")

    def share(part: Column, whole: Column, bad: float) -> Column:
        return F.when((n >= LEAST_WORDS) & (part / F.greatest(whole, F.lit(1)) >= bad), -1).otherwise(0)

    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    return {
        "long_enough": F.when(n < LEAST_WORDS, -1).when(n >= 50, 1).otherwise(0),
        "few_symbols": share(F.col("n_symbols"), n, 0.1),
        "little_markup": share(F.col("n_symbols"), F.col("word_chars"), 0.05),
        "new_lines": share(F.col("n_dup_lines"), F.col("n_lines"), 0.3),
        "new_words": share(F.col("n_repeat_words"), n, 0.25),
        "few_dittos": share(F.col("n_ditto"), n, 0.2),
        "few_capitals": share(F.col("n_upper"), F.col("n_letters"), 0.5),
        "mostly_letters": share(F.col("word_chars") - F.col("n_letters"), F.col("word_chars"), 0.2),
        "usual_words": F.when(n < LEAST_WORDS, 0).when((mean < 2) | (mean > 12), -1).when((mean >= 3) & (mean <= 9), 1).otherwise(0),
    }


#: Rates of the votes -1, 0, 1 that good and bad documents are believed to get before any is seen.  The
#: belief counts as much as `BELIEF` of all documents: it names the classes, and holds kinds of junk
#: that no other rule notices together with the rest.
BELIEVED = np.array([[0.002, 0.498, 0.5], [0.3, 0.4, 0.3]])
BELIEF = 0.5


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(log odds of good before any vote, log odds by rule and vote -1, 0, 1).

    Votes are taken as independent given the quality.
    """
    chosen = patterns[:, :, None] == np.array([-1, 0, 1])[None, None, :]
    total = counts.sum()
    prior, odds = np.log(9.0), np.repeat(np.log(BELIEVED[0] / BELIEVED[1])[None, :], patterns.shape[1], axis=0)
    for _ in range(rounds):
        good = 1 / (1 + np.exp(-np.clip(prior + (chosen * odds[None]).sum((1, 2)), -500, 500)))
        weight = np.stack([counts * good, counts * (1 - good)])
        seen = np.einsum("cp,prv->crv", weight, chosen) + (BELIEF * total + 1) * BELIEVED[:, None, :]
        rate = seen / seen.sum(2, keepdims=True)
        share = (weight[0].sum() + 9) / (total + 10)
        new = np.log(share / (1 - share)), np.log(rate[0] / rate[1])
        moved = abs(new[0] - prior) + np.abs(new[1] - odds).max(initial=0)
        prior, odds = new
        if moved < 1e-9:
            break
    return float(prior), odds


def judge_quality(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures, votes, posterior, base_failed, kept) per row of `docs`.

    `base_failed` documents are never kept; others are if the posterior reaches the threshold.  Null
    and empty texts have no words and fail; repeated rows are judged alike and count as often; an
    empty table gives no rows; other columns are ignored.  Runs actions (the measures are written once).
    """
    rules = votes()
    measured = stored(measure(docs, key, text).withColumns({f"vote_{r}": c for r, c in rules.items()}))
    names = [f"vote_{r}" for r in rules]
    # at most 3 ** 9 rows
    counted = measured.groupBy(*names).count().collect()
    patterns = np.array([[r[c] for c in names] for r in counted], np.int64).reshape(len(counted), len(names))
    prior, odds = estimate(patterns, np.array([r["count"] for r in counted], float))
    total = F.lit(prior)
    for c, o in zip(names, odds.tolist(), strict=True):
        total = total + F.when(F.col(c) < 0, o[0]).when(F.col(c) > 0, o[2]).otherwise(o[1])
    n = F.col("n_words")
    judged = measured.withColumns({"posterior": 1 / (1 + F.exp(-total)), "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).withColumnRenamed("key", key)
