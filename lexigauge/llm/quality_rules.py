"""Quality rules with risk-controlled thresholds (DataFrame operations only).

Counts per text are built-in expressions over the whole text. The cutoffs of the rules are not
given: for each stratum (language) and rule a labelled holdout tells how many good documents a
cutoff would reject, and a cutoff is used only if the exact binomial test rejects, at a corrected
level, that its false-rejection rate exceeds the rule's share of ``alpha``. Each rule's cutoffs are
tested from the loosest to the tightest and testing stops at the first that fails (a fixed
sequence needs no further correction); strata times rules are corrected by Bonferroni. So with
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to the rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_PATTERN, WORD_PATTERN, local_rows, staged

WINDOW = 5
MIN_WORDS = 10
ALPHA = 0.02
DELTA = 0.05

#: Cutoffs of each rule, loosest first. A document is rejected when its value is above the cutoff.
CUTOFFS = {
    "symbol_ratio": [1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.05],
    "dup_line_ratio": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2],
    "repeat_ratio": [0.19, 0.15, 0.1, 0.08, 0.05],
    "mean_word_chars": [40.0, 20.0, 15.0, 12.0, 10.0],
}


def _words(text: Column) -> Column:
    # split is cheaper than extracting matches; the empty string at either end goes
    return F.filter(F.split(text, SEPARATOR_PATTERN), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """xxhash64 of each 5-word window, empty when there are fewer words."""
    n = F.size(words)
    return F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - F.lit(WINDOW)),
            lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def text_counts(docs: DataFrame) -> DataFrame:
    """Adds to (doc_id, text, ...) the counts of the whole text; null text has no words.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of
    ``#*$%&|<>``), ``n_lines`` (lines with a word), ``n_dup_lines`` (those equal to an earlier
    line) and ``n_repeat_words`` (words in 5-word windows that the text holds twice or more).
    ``text`` goes. Windows of one text are compared by a 64-bit hash of their five words.

    Everything stays in the text's own row: no shuffle. Only for texts that hold a repeated window
    are windows sorted with their positions, n log n in the length of that text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_PATTERN))
    rows = (
        docs.withColumn("_words", _words(text))
        .withColumn("_windows", _window_hashes(F.col("_words")))
        .withColumn("_lines", lines)
        .select(
            *[c for c in docs.columns if c != "text"],
            F.size("_words").cast("long").alias("n_words"),
            F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ).alias("_sorted"),
        )
    )
    neighbour = lambda k: F.get(F.col("_sorted"), k)["h"]
    repeated = F.filter(
        "_sorted",
        lambda p, k: p["h"].eqNullSafe(neighbour(k - F.lit(1))) | p["h"].eqNullSafe(neighbour(k + F.lit(1))),
    )
    # positions in order; each adds the words that the window before it doesn't reach
    at = F.sort_array(F.transform(repeated, lambda p: p["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
    )["n"]
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _with_ratios(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (
        counts.withColumn("symbol_ratio", ratio("n_symbols", "word_chars"))
        .withColumn("dup_line_ratio", ratio("n_dup_lines", "n_lines"))
        .withColumn("repeat_ratio", ratio("n_repeat_words", "n_words"))
        .withColumn("mean_word_chars", ratio("word_chars", "n_words"))
        .withColumn("base_failed", base_failed())
    )


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) for X ~ Bin(n, p), summed from its largest term until the rest can't matter."""
    if x >= n * p:
        return 1.0  # far above any level that is tested
    log = (
        math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)
    )
    total, term, k = 1.0, 1.0, x
    while k > 0 and term > 1e-17 * total:
        term *= k / (n - k + 1) * (1 - p) / p
        total += term
        k -= 1
    return math.exp(log) * total


def certified_cutoffs(
    holdout: list[tuple[str, int, dict[str, list[int]]]], alpha: float = ALPHA, delta: float = DELTA
) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff) for (stratum, good documents, {rule: false rejections by cutoff}).

    Takes the tightest cutoff of the rule's sequence before the first that fails its test. A stratum
    with too few labelled documents gets no cutoff: nothing is rejected there.
    """
    level = delta / max(1, len(holdout) * len(CUTOFFS))
    share = alpha / len(CUTOFFS)
    out = []
    for stratum, n, rejected in holdout:
        for rule, cutoffs in CUTOFFS.items():
            best = None
            for cutoff, x in zip(cutoffs, rejected[rule], strict=True):
                if binomial_tail(x, n, share) > level:
                    break
                best = cutoff
            if best is not None:
                out.append((stratum, rule, best))
    return out


def fit_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row per stratum with a cutoff per rule (null: none certified).

    What reaches the driver is one row of counts per stratum, however many documents are labelled.
    """
    good = measured.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").where(
        ~F.col("base_failed")
    )
    sums = [
        F.sum((F.col(rule) > c).cast("long")).alias(f"{rule}:{k}")
        for rule, cutoffs in CUTOFFS.items()
        for k, c in enumerate(cutoffs)
    ]
    counted = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums).orderBy("stratum")
    holdout = [
        (r["stratum"], r["n"], {rule: [r[f"{rule}:{k}"] for k in range(len(c))] for rule, c in CUTOFFS.items()})
        for r in counted.toLocalIterator()
    ]
    chosen: dict[str, dict[str, float]] = {}
    for stratum, rule, cutoff in certified_cutoffs(holdout, alpha, delta):
        chosen.setdefault(stratum, {})[rule] = cutoff
    columns = ["stratum string", *(f"cut_{rule} double" for rule in CUTOFFS)]
    rows = [(s, *[c.get(rule) for rule in CUTOFFS]) for s, c in chosen.items()]
    return local_rows(measured.sparkSession, rows, ", ".join(columns))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, verdicts and reasons for each row of ``docs`` (doc_id, text, lang).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and ``reasons`` (names of the rules that reject). Null or empty text has no words and fails the
    base rule. A null language is a stratum of its own, an empty one another. Without labels no
    cutoff is certified and the base rule alone decides. Rows come back one for one, repeated rows
    and null ids included; other columns of ``docs`` are ignored, whatever their names.
    """
    return _judged(docs.select("doc_id", "text", _stratum()), labels, alpha, delta).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (F.size("reasons") == 0).alias("kept"),
        "reasons",
    )


def _stratum() -> Column:
    """The language, marked so that null and the empty text differ."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("stratum")


def _judged(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``rows`` (doc_id, text, stratum, ...) without their text, with counts and reasons: read once, moved nowhere."""
    measured = staged(_with_ratios(text_counts(rows)), "quality-measured")
    judged = measured.join(fit_cutoffs(measured, labels, alpha, delta), "stratum", "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("base_failed"), F.lit("base")),
            *[F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in CUTOFFS],
        )
    )
    return judged.withColumn("reasons", reasons)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Each row carries itself beside its counts, so its own verdict decides, whatever other rows its id
    has, and no text is shuffled.
    """
    rows = docs.select("doc_id", "text", _stratum(), F.struct(*docs.columns).alias("_row"))
    return _judged(rows, labels).where(F.size("reasons") == 0).select("_row.*")
