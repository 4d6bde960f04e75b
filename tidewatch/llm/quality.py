"""Quality rules whose cutoffs carry a guarantee on all rules together.

Every rule gives a text a score that grows with junk. Labelled texts are dealt
into a tuning half and a holdout by their content, copies of a text being one
trial. Per stratum (language) the tuning half lays out levels: at each, every
rule has a cutoff, none looser than a level before; a level rejects what any
rule rejects. The holdout then tests the levels in turn, each as a whole: of n
good texts k are rejected, and the exact binomial tail P(Bin(n, limit) <= k)
must stay below alpha divided by the number of strata; the first failure ends
the sequence (fixed-sequence testing, so no further correction along it is due).
So with probability 1 - alpha no stratum loses more than `limit` of its good
texts, whichever rules act. Of the certified levels the tuning half's most useful
one is taken. At alpha 0.05, limit 1 % and four strata, a stratum needs 437 good
holdout texts that no rule rejects; with fewer it certifies nothing and keeps all
that the base rules keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import checkpointed, column, masked, stored, texts

#: The base rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FALSE_REJECTION, ALPHA = 0.01, 0.05
GOOD_COST = 20.0
BROADCAST_ROWS = 10_000
STEPS = 80
#: Shares of the good texts that a rule may lose by itself, level by level.
LOSSES = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)

_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in 3-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    m = len(known)
    if m == n:
        return 0
    pair = ids[:-1] * m + ids[1:]
    if m > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * m + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice[1:] |= twice[:-1].copy()  # a window starts here or one before
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = starts[order[:-1][same]] = True
    twice[2:] |= starts[:-2]
    return int(twice.sum())


def counts_of(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    if not words:
        return (0, 0, len(text) - len(text.translate(None, _SYMBOLS)), 0, 0, 0, 0, 0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = text.translate(None, _SPACE)
    return (
        len(words),
        len(bare.decode("utf-8")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        text.count(b"!"),
    )


def _count(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.array([counts_of(t) for t in texts(batch)], np.int64)
                own = [pa.array(found[:, i]) for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in carry), *own], names=[*carry, *COUNTS])

    return run


def with_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns, then COUNTS of each whole text."""
    kept = docs.select(*dict.fromkeys([*carry, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in carry]
    return kept.mapInArrow(_count(carry), ", ".join([*kinds, *(f"{c} long" for c in COUNTS)]))


def rule_scores() -> dict[str, Column]:
    """Junk scores of the rules, each from 0 (clean) up; all are 0 for a text without words."""
    words, chars = F.col("n_words"), F.col("word_chars")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbols": per(F.col("n_symbols"), words),
        "long_words": per(chars, words) / 40,
        "short_words": F.when(words > 0, F.greatest(F.lit(0.0), 1 - per(chars, words) / 5)).otherwise(0.0),
        "dup_lines": per(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": per(F.col("n_repeat_words"), words),
        "capitals": per(F.col("n_upper"), chars),
        "exclaims": per(F.col("n_exclaims"), words),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in the log domain."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def lay_levels(good: np.ndarray, junk: np.ndarray) -> np.ndarray:
    """Cutoffs [levels, rules] from the tuning half's counts [rules, steps] of good and junk texts; STEPS + 1 stands for none.

    At a level a rule may lose so many good texts of its own, LOSSES of them; its
    cutoff is the one that is of most use then: junk rejected less GOOD_COST times
    good texts lost.
    """
    above = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
    lost, hit = above(good), above(junk)
    use = hit - GOOD_COST * lost
    use[:, 0] = -1.0  # a cutoff at 0 would reject all
    cuts = np.full((len(LOSSES), len(good)), STEPS + 1)
    for level, share in enumerate(LOSSES):
        open_to = np.where((lost <= share * good.sum(axis=1, keepdims=True)) & (use > 0), use, 0.0)
        best = open_to.shape[1] - 1 - np.argmax(open_to[:, ::-1], axis=1)
        cuts[level] = np.where(open_to.max(axis=1) > 0, best, STEPS + 1)
    return np.minimum.accumulate(cuts, axis=0)


def certified_level(held_good: np.ndarray, tune_good: np.ndarray, tune_junk: np.ndarray, alpha: float, limit: float) -> int | None:
    """The chosen level, or None. Arrays count texts by the first level that rejects them, the last entry those that none rejects."""
    n, lost = int(held_good.sum()), np.cumsum(held_good[:-1])
    use = np.cumsum(tune_junk[:-1]) - GOOD_COST * np.cumsum(tune_good[:-1])
    best, best_use = None, 0.0
    for level, k in enumerate(lost.astype(int)):
        if k > n * limit or binomial_tail(int(k), n, limit) > alpha:
            break
        if use[level] > best_use:
            best, best_use = level, float(use[level])
    return best


def _lay(names: list[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((2, len(names), STEPS + 1))
        np.add.at(counts, (rows.good.to_numpy(int), rows.rule.map(names.index).to_numpy(int), rows.step.to_numpy(int)), rows["rows"].to_numpy(float))
        levels = lay_levels(counts[1], counts[0])
        return pd.DataFrame({"stratum": [key[0]], "levels": [levels.astype("int32").tolist()]})

    return run


def _choose(alpha: float, limit: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {}
        for held, good in ((1, 1), (0, 1), (0, 0)):
            part = rows[(rows.held == held) & (rows.good == good)]
            counts[held, good] = np.bincount(part.level, weights=part["rows"], minlength=len(LOSSES) + 1)
        level = certified_level(counts[1, 1], counts[0, 1], counts[0, 0], alpha, limit)
        return pd.DataFrame({"stratum": [key[0]], "level": [level]} if level is not None else {"stratum": [], "level": []}).astype({"stratum": object, "level": "int64"})

    return run


def _step(score: Column) -> Column:
    """Scores fall on STEPS + 1 steps, finer near 0."""
    return F.least(F.lit(STEPS), F.floor(F.sqrt(score) * STEPS)).cast("int")


def fit_cutoffs(counted: DataFrame, labels: DataFrame, limit: float = FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """Certified cutoffs from all labelled rows: stratum, and a step per rule.

    counted: doc_id, lang, th and COUNTS. Rows that fail the base rules are left out:
    the rules judge what those let through. A doc_id with several labels takes the
    worst, and so do rows of one stratum and text; null labels and null ids are no
    labels.
    """
    scores = rule_scores()
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    steps = F.array(*[_step(s) for s in scores.values()])
    known = counted.where(~base_failed()).select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "th", steps.alias("steps")).join(marks, "doc_id")
    held = F.pmod(F.xxhash64("th", F.lit(7)), F.lit(2)).cast("int").alias("held")
    trials = checkpointed(known.groupBy("stratum", "th").agg(F.min((F.col("good") > 0).cast("int")).alias("good"), F.first("steps").alias("steps")).select("stratum", "good", held, "steps"))
    names = list(scores)
    by_rule = trials.where("held = 0").select("stratum", "good", F.posexplode("steps").alias("at", "step")).groupBy("stratum", "good", "at", "step").agg(F.count("*").alias("rows"))
    by_rule = by_rule.withColumn("rule", F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1))
    levels = checkpointed(by_rule.groupBy("stratum").applyInPandas(_lay(names), "stratum string, levels array<array<int>>"))
    rejecting = lambda cuts, i: F.when(F.exists(F.zip_with("steps", cuts, lambda step, cut: step >= cut), lambda x: x), i)
    at = F.array_compact(F.transform("levels", rejecting))
    met = trials.join(_bounded(levels), "stratum").select("stratum", "good", "held", F.coalesce(F.get(at, F.lit(0)), F.lit(len(LOSSES))).alias("level"))
    by_level = met.groupBy("stratum", "good", "held", "level").agg(F.count("*").alias("rows"))
    strata = max(1, levels.count())
    chosen = by_level.groupBy("stratum").applyInPandas(_choose(alpha / strata, limit), "stratum string, level long")
    return checkpointed(levels.join(chosen, "stratum").select("stratum", F.get("levels", F.col("level").cast("int")).alias("cuts")))


def _bounded(strata: DataFrame) -> DataFrame:
    """A table of one row a stratum, to broadcast if it is as small as that should be."""
    return F.broadcast(strata) if strata.count() <= BROADCAST_ROWS else strata


def with_verdict(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counted with base_failed and kept; a stratum without cutoffs is held to the base rules alone."""
    joined = counted.join(_bounded(cutoffs), F.coalesce(counted["lang"], F.lit("")) == cutoffs["stratum"], "left")
    rejected = F.lit(False)
    for at, score in enumerate(rule_scores().values()):
        rejected = rejected | F.coalesce(_step(score) >= F.get("cuts", F.lit(at)), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rejected)).drop("stratum", "cuts")


def judge_quality(docs: DataFrame, labels: DataFrame, limit: float = FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are
    judged alike. Without labels only the base rules hold. Columns other than
    doc_id, lang and text are not read.
    """
    counted = checkpointed(with_counts(_hashed(docs.select("doc_id", "lang", "text")), ["doc_id", "lang", "th"]))
    judged = with_verdict(counted, fit_cutoffs(counted, labels, limit, alpha))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "kept")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("th", F.xxhash64("text"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, limit: float = FALSE_REJECTION, alpha: float = ALPHA) -> DataFrame:
    """docs, all columns, less the rows that judge_quality rejects; rows of one text and language share a verdict.

    Texts are counted once: rows and counts are stored in the shared folder, where
    the fit reads the narrow columns alone.
    """
    docs, names = masked(docs)
    rows = stored(with_counts(_hashed(docs), [*docs.columns, "th"]))
    return with_verdict(rows, fit_cutoffs(rows, labels, limit, alpha)).where("kept").select(*docs.columns).toDF(*names)
