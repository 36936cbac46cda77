"""Operator 9, quality rules: weak supervision over rules that vote or abstain.

Each rule looks at one statistic of a text and votes good (+1), bad (-1) or abstains (0). The
accuracies of the rules and the share of good texts are not set by hand: expectation-maximisation
estimates them from how the rules agree over the whole corpus. A text is kept if its posterior
probability of being good is at least ``KEEP_AT``, and if it does not fail the base rules.

Scale: one narrow pass computes statistics and votes; the votes of all texts are summed into at
most ``3 ** len(RULES)`` patterns by a map-side-combined aggregation, so what the driver gets is
bounded by the number of rules, whatever the corpus. The learned table goes back as one
broadcast table of the same bound. No row is shuffled with its text.

Edge cases: a null text counts as empty; an empty text has zero words and fails the base rules;
repeated rows are judged alike; extra columns are carried along (generated columns start with
``_q_``); an empty table gives an empty result; null doc_ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import Words, array_slices, checkpoint, mix, table

KEEP_AT = 0.5
EM_ROUNDS = 200
#: Laplace smoothing of the estimated vote tables, in texts.
SMOOTH = 1.0
#: What is believed of any rule before a text is seen: the shares of its votes (bad, none, good) in
#: good and in bad texts. A bad vote is rare in good texts; a good vote says little.
PRIOR_VOTES = {"good": (0.03, 0.30, 0.67), "bad": (0.30, 0.25, 0.45)}
#: Weight of that belief against the texts, as a share of them: alike at every size.
PRIOR_SHARE = 0.005
#: Log odds of good that the first round starts from: without votes, for a bad vote, for a good one.
START = (1.0, -2.2, 0.2)
PRIOR_GOOD = 0.8

STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_letters bigint, n_code_points bigint, n_end_marks bigint, n_distinct_words bigint, n_upper bigint"
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of an array (no nulls)."""
    n = len(texts)
    w = Words(texts)
    counts, owner = w.counts, w.owner
    lengths = pc.utf8_length(w.words).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = np.bincount(owner, weights=lengths[w.ids] if len(lengths) else None, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)
    symbols = sum((pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in SYMBOLS), np.zeros(n, np.int64))
    marks = sum((pc.count_substring(texts, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ".!?"), np.zeros(n, np.int64))
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = points - pc.count_substring_regex(texts, r"[\x00-\x40\x5B-\x60\x7B-\x7F]").to_numpy(zero_copy_only=False).astype(np.int64)
    upper = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False).astype(np.int64)
    # lines
    lists = pc.split_pattern(texts, "\n")
    at = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten()
    line_owner = np.repeat(np.arange(n), np.diff(at))
    worded = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[worded]
    lo = line_owner[worded]
    n_lines = np.bincount(lo, minlength=n)
    distinct_lines = np.bincount(np.unique(np.stack([lo, codes], 1), axis=0)[:, 0], minlength=n) if len(lo) else np.zeros(n, np.int64)
    # words in 3-word windows that occur twice or more in their text
    repeat = np.zeros(n, np.int64)
    ids = w.ids
    if len(ids) >= 3:
        inside = owner[:-2] == owner[2:]
        start = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            key = ids[start].astype(np.uint64)
            for j in (1, 2):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + ids[start + j].astype(np.uint64) + np.uint64(j))
            key = mix(key + owner[start].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:].copy()
        first = start[order[same]]
        covered = np.zeros(len(ids), bool)
        for j in range(3):
            covered[first + j] = True
        repeat = np.bincount(owner[covered], minlength=n)
    pairs = np.unique(owner * (len(w.words) + 1) + ids) if len(ids) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // (len(w.words) + 1), minlength=n)
    values = (counts, word_chars, symbols, n_lines - distinct_lines, repeat, n_lines, letters, points, marks, distinct, upper)
    return dict(zip(STAT_NAMES, values, strict=True))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``_q_stats``, computed in Arrow batches beside the text.

    The UDF is marked as not deterministic, so that a filter on its result is not pushed below it
    and the statistics are computed once per row, however often they are looked at.
    """

    @F.arrow_udf(STATS)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [statistics(t) for t in array_slices(texts)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]).astype(np.int64)) for k in STAT_NAMES], STAT_NAMES)

    return docs.withColumn("_q_stats", stats.asNondeterministic()(F.col(text)))


def _share(top: str, bottom: str) -> Column:
    s = F.col("_q_stats")
    return s[top] / F.greatest(s[bottom], F.lit(1))


def _between(value: Column, good: tuple[float, float], fair: tuple[float, float]) -> Column:
    """Good inside the inner range, bad outside the outer one, else no vote."""
    return F.when((value < fair[0]) | (value > fair[1]), -1).when((value >= good[0]) & (value <= good[1]), 1).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote. Cut-offs in the units of each statistic."""
    words = F.col("_q_stats")["n_words"].cast("double")
    return {
        "length": _between(words, (80, 1e5), (50, 1e7)),
        "word_length": _between(_share("word_chars", "n_words"), (3.0, 10.0), (2.0, 14.0)),
        "symbols": _between(_share("n_symbols", "n_words"), (0.0, 0.05), (0.0, 0.2)),
        "repeated_lines": _between(_share("n_dup_lines", "n_lines"), (0.0, 0.1), (0.0, 0.35)),
        "repeated_words": _between(_share("n_repeat_words", "n_words"), (0.0, 0.2), (0.0, 0.5)),
        "letters": _between(_share("n_letters", "n_code_points"), (0.7, 1.0), (0.55, 1.0)),
        "sentences": _between(_share("n_end_marks", "n_words"), (0.02, 0.4), (0.004, 0.6)),
        "capitals": _between(_share("n_upper", "n_letters"), (0.0, 0.12), (0.0, 0.35)),
        "variety": _between(_share("n_distinct_words", "n_words"), (0.15, 1.0), (0.08, 1.0)),
    }


def pattern() -> Column:
    """All votes of a text as one number in base 3."""
    out = F.lit(0)
    for vote in rules().values():
        out = out * 3 + (vote + 1)
    return out.cast("int")


def base_failed() -> Column:
    s = F.col("_q_stats")
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation.

    Two latent classes; given the class, rules vote independently. Each rule has a table
    P(vote | class), lightly held at PRIOR_VOTES. Rounds start from START, where a bad vote weighs
    more than a good one, so that the classes keep their meaning; abstentions carry what the data say of them.
    """
    n = len(rules())
    codes = np.array(sorted(counts), np.int64)
    weight = np.array([counts[int(c)] for c in codes], float)
    if not len(codes):
        return {}
    votes = (codes[:, None] // 3 ** np.arange(n - 1, -1, -1)[None, :]) % 3  # 0 bad, 1 none, 2 good
    prior = np.empty((2, n, 3))  # class 0 bad, 1 good
    prior[1], prior[0] = PRIOR_VOTES["good"], PRIOR_VOTES["bad"]
    tables, good = prior.copy(), PRIOR_GOOD
    one_hot = np.eye(3)[votes]
    odds = START[0] + START[1] * (votes == 0).sum(1) + START[2] * (votes == 2).sum(1)
    for k in range(EM_ROUNDS):
        p = _posterior(votes, tables, good) if k else 1 / (1 + np.exp(-odds))
        new = (weight * p).sum() / weight.sum()
        for c, q in ((1, p), (0, 1 - p)):
            seen = np.einsum("i,irv->rv", weight * q, one_hot) + SMOOTH / 3 + PRIOR_SHARE * weight.sum() * prior[c]
            tables[c] = seen / seen.sum(1, keepdims=True)
        moved, good = abs(new - good), min(max(new, 1e-6), 1 - 1e-6)
        if moved < 1e-9:
            break
    return dict(zip(codes.tolist(), _posterior(votes, tables, good).tolist(), strict=True))


def _posterior(votes: np.ndarray, tables: np.ndarray, good: float) -> np.ndarray:
    at = np.arange(votes.shape[1])
    odds = np.log(good / (1 - good)) + (np.log(tables[1][at, votes]) - np.log(tables[0][at, votes])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def learned(patterns: DataFrame, column: str = "_q_pattern") -> dict[int, float]:
    """Fit on the pattern counts of all rows: at most 3 ** rules rows reach the driver."""
    rows = patterns.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit({r[column]: r["n"] for r in rows if r[column] is not None})


def with_posterior(marked: DataFrame, posterior: dict[int, float], column: str = "_q_pattern") -> DataFrame:
    """marked with _q_posterior; the table that is sent has at most 3 ** rules rows."""
    learned_rows = marked.sparkSession.createDataFrame(sorted(posterior.items()), f"{column} int, _q_posterior double")
    return marked.join(F.broadcast(learned_rows), column, "left")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _q_stats, _q_pattern, _q_base_failed, _q_posterior and _q_kept.

    The statistics are computed twice, once for the fit and once for the verdicts: that costs a
    second scan, but no copy of the texts.
    """
    marked = with_statistics(docs, text).withColumn("_q_pattern", pattern())
    narrow = with_statistics(docs.select(F.col(text).alias("text")), "text").select(pattern().alias("_q_pattern"))
    return _verdict(marked, learned(narrow))


def _verdict(marked: DataFrame, posterior: dict[int, float]) -> DataFrame:
    return (
        with_posterior(marked, posterior)
        .withColumn("_q_base_failed", base_failed())
        .withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_posterior") >= KEEP_AT))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    return judge(docs, text).where("_q_kept").select(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = checkpoint(with_statistics(docs).drop("text").withColumn("_q_pattern", pattern()))
    s = F.col("_q_stats")
    return _verdict(marked, learned(marked)).select(
        "doc_id",
        *[s[c].alias(c) for c in STAT_NAMES[:5]],
        F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"),
        F.col("_q_posterior").alias("posterior"),
        F.col("_q_pattern").alias("vote_pattern"),
    )
