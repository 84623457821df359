"""Quality rules with risk-controlled thresholds.

Fixed base rules reject texts under ten words or with over a fifth of their words in repeated five-word windows.
Further rules reject a text when a measure passes a cutoff. Cutoffs are chosen per stratum on labelled documents:
a cutoff is admissible when the exact (Clopper-Pearson) upper bound of the share of good documents it rejects
stays under the rule's part of ``false_rejection``. Each rule's cutoffs are tested from lenient to strict and the
testing stops at the first that fails, so one rule spends one error level; the level ``risk`` is divided by rules
times strata (Bonferroni). With probability ``1 - risk`` no stratum loses more than ``false_rejection`` of its good
documents. Among admissible cutoffs the one that rejects most bad labelled documents is taken, the most lenient of
equals; a rule without an admissible cutoff that rejects anything stays off.

Defined cases: null and empty texts have no words and fail the base rules; a null stratum is a stratum; strata
without labelled documents keep everything but base failures; a document with several labels is good only if all
say so, and unlabelled when they are null; repeated rows are documents each; an empty table gives an empty result;
other columns pass through ``kept_only`` unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore.llm.words import SPACE, RollingHash, find_words, slices, text_buffer
from trustscore.session import materialized

MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20
WHITE = " \t\n\x0b\x0c\r"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_POINT = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: Rule -> cutoffs from lenient to strict; a text is rejected when its measure is above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "duplicate_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_word_share": (0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04),
    "mean_word_chars": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0),
    "upper_case_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
}


def _duplicate_lines(text: str | None) -> tuple[int, int]:
    """(lines with a word equal to an earlier line, lines with a word)."""
    lines = [line for line in (text or "").split("\n") if line.strip(WHITE)]
    return len(lines) - len(set(lines)), len(lines)


def _repeated(words) -> np.ndarray:
    """Words of each text in windows that stand in it more than once."""
    count = len(words.hashes)
    rows = len(words.first) - 1
    starts = np.arange(max(0, count - REPEAT_WINDOW + 1))
    starts = starts[words.row[starts] == words.row[starts + REPEAT_WINDOW - 1]] if len(starts) else starts
    windows = RollingHash(words.hashes).windows(starts, starts + REPEAT_WINDOW)
    order = np.lexsort((windows, words.row[starts]))
    row, value = words.row[starts][order], windows[order]
    same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = starts[order][twice]
    change = np.zeros(count + 1, dtype=np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + REPEAT_WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0
    return np.bincount(words.row[covered], minlength=rows)


def measured(documents: DataFrame, names: tuple[str, ...], text: str = "text") -> DataFrame:
    """The named columns of every row and the measures of its ``text``, as one more column ``_measures``."""
    fields = ", ".join(f"`{name}` {documents.schema[name].dataType.simpleString()}" for name in names)
    columns = list(dict.fromkeys([*names, text]))
    struct = ", ".join(f"{name}: bigint" for name in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(text))
            for start, stop in slices(offsets):
                part = offsets[start : stop + 1]
                raw, edges = data[part[0] : part[-1]], part - part[0]
                words = find_words(raw, edges)

                def counted(flags: np.ndarray) -> np.ndarray:
                    sums = np.zeros(len(raw) + 1, dtype=np.int64)
                    np.cumsum(flags[raw], out=sums[1:])
                    return np.diff(sums[edges])

                rows = batch.slice(start, stop - start)
                lines = np.array([_duplicate_lines(v.as_py()) for v in rows.column(text)], dtype=np.int64).reshape(-1, 2)
                values = (
                    np.diff(words.first).astype(np.int64),
                    counted(_POINT),
                    counted(_SYMBOL),
                    lines[:, 0],
                    _repeated(words).astype(np.int64),
                    lines[:, 1],
                    counted(_UPPER),
                    counted(_LETTER),
                )
                found = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in values], names=list(MEASURES))
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], found], names=[*names, "_measures"])

    return documents.select(*columns).mapInArrow(run, f"{fields}, `_measures` struct<{struct}>")


def base_failed(measures: Column) -> Column:
    words = measures["n_words"]
    return (words < MIN_WORDS) | (100 * measures["n_repeat_words"] > REPEAT_PERCENT * words)


def rule_values(measures: Column) -> dict[str, Column]:
    """The value each rule compares with its cutoff."""

    def share(part: str, whole: str) -> Column:
        return F.when(measures[whole] > 0, measures[part] / measures[whole]).otherwise(F.lit(0.0))

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeated_word_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "upper_case_share": share("n_upper", "n_letters"),
    }


def upper_bound(failures: int, trials: int, level: float) -> float:
    """Exact upper confidence bound of a share: the largest p with P(Binomial(trials, p) <= failures) >= level."""
    if failures >= trials:
        return 1.0

    def at_most(p: float) -> float:
        total, log_p, log_q = 0.0, math.log(p), math.log1p(-p)
        head = math.lgamma(trials + 1)
        for k in range(failures, -1, -1):
            term = math.exp(head - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * log_p + (trials - k) * log_q)
            total += term
            if term < total * 1e-17:
                break
        return total

    low, high = failures / trials, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if middle in (0.0, 1.0):
            break
        low, high = (middle, high) if at_most(middle) >= level else (low, middle)
    return high


def choose_cutoff(
    good: np.ndarray, bad: np.ndarray, good_total: int, limit: float, level: float
) -> int | None:
    """Index of the cutoff to take: ``good[i]``, ``bad[i]`` are the documents rejected by cutoff i, lenient first."""
    best = None
    for index in range(len(good)):
        if upper_bound(int(good[index]), good_total, level) > limit:
            break
        if bad[index] > (bad[best] if best is not None else 0):
            best = index
    return best


def cutoffs(
    labelled: DataFrame, false_rejection: float = 0.02, risk: float = 0.05
) -> DataFrame:
    """Cutoffs per stratum from rows of ``stratum, good`` and ``_measures``: one column per rule, null where off."""

    def passed(rule: str, value: Column) -> Column:
        """How many cutoffs the value is above."""
        return F.size(F.filter(F.array(*map(F.lit, RULES[rule])), lambda cutoff: value > cutoff))

    values = rule_values(F.col("_measures"))
    spread = F.array(
        *[F.struct(F.lit(rule).alias("rule"), passed(rule, value).alias("passed")) for rule, value in values.items()]
    )
    counted = (
        labelled.where(~base_failed(F.col("_measures")))
        .select(F.struct("stratum").alias("s"), "good", F.explode(spread).alias("r"))
        .groupBy("s", "r.rule", "r.passed")
        .agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    )
    counted = materialized(counted, "rule-counts")
    strata = counted.agg(F.count_distinct("s")).first()[0] or 1
    level = risk / (strata * len(RULES))
    limit = false_rejection / len(RULES)

    def chosen(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        picked = {}
        for rule, grid in RULES.items():
            own = rows[rows["rule"] == rule]
            good, bad = np.zeros(len(grid) + 1, dtype=np.int64), np.zeros(len(grid) + 1, dtype=np.int64)
            np.add.at(good, own["passed"], own["good"])
            np.add.at(bad, own["passed"], own["bad"])
            # A value above n cutoffs is above the n strictest: cutoff i rejects what is above len(grid) - i or more.
            rejected_good, rejected_bad = (counts[::-1].cumsum()[:-1] for counts in (good, bad))
            index = choose_cutoff(rejected_good, rejected_bad, int(good.sum()), limit, level)
            picked[rule] = None if index is None else float(grid[index])
        return pd.DataFrame([{"stratum": key[0], **picked}])

    kind = labelled.schema["stratum"].dataType.simpleString()
    schema = f"stratum {kind}, " + ", ".join(f"{rule} double" for rule in RULES)
    return counted.select("s.stratum", "rule", "passed", "good", "bad").groupBy("stratum").applyInPandas(chosen, schema)


def labels_of(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` from labels whose ``quality`` is 1 for good documents."""
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def _cutoffs_from(rows: DataFrame, labels: DataFrame, false_rejection: float, risk: float) -> DataFrame:
    labelled = rows.join(labels_of(labels), "doc_id").select("stratum", "good", "_measures")
    return materialized(cutoffs(labelled, false_rejection, risk), "cutoffs")


def _kept(measures: Column) -> Column:
    rejected = [F.coalesce(value > F.col(f"_c.{rule}"), F.lit(False)) for rule, value in rule_values(measures).items()]
    kept = ~base_failed(measures)
    for rule in rejected:
        kept = kept & ~rule
    return kept


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang", false_rejection: float = 0.02, risk: float = 0.05):
    """Every document's measures and verdict: ``doc_id``, the measures, ``base_failed``, ``kept``."""
    rows = documents.select("doc_id", F.col(stratum).alias("stratum"), "text")
    known = materialized(measured(rows, ("doc_id", "stratum")), "measures")
    chosen = _cutoffs_from(known, labels, false_rejection, risk)
    measures = F.col("_measures")
    return known.join(chosen.alias("_c"), known["stratum"].eqNullSafe(F.col("_c.stratum")), "left").select(
        "doc_id", "_measures.*", base_failed(measures).alias("base_failed"), _kept(measures).alias("kept")
    )


def kept_only(documents: DataFrame, labels: DataFrame, stratum: str = "lang", false_rejection: float = 0.02, risk: float = 0.05):
    """The rows of ``documents`` that pass, with all their columns."""
    names = documents.columns
    place = {name: f"c{i}" for i, name in enumerate(names)}
    held = documents.toDF(*place.values())
    fit = held.select(
        F.col(place["doc_id"]).alias("doc_id"), F.col(place[stratum]).alias("stratum"), F.col(place["text"]).alias("text")
    )
    chosen = _cutoffs_from(measured(fit, ("doc_id", "stratum")), labels, false_rejection, risk)
    judged = measured(held, tuple(place.values()), place["text"])
    return (
        judged.join(chosen.alias("_c"), judged[place[stratum]].eqNullSafe(F.col("_c.stratum")), "left")
        .where(_kept(F.col("_measures")))
        .select(*place.values())
        .toDF(*names)
    )
