"""Metrics of a (reference, prediction) pair as column expressions.

Edit distances are the built-in code-point ``levenshtein`` behind the shortcuts that the optimizer
doesn't know: equal texts and empty texts need no matrix. Word distances map each distinct word of a
pair to one code point first. Two things are Arrow UDFs: the n-gram score, whose multiset overlap no
built-in computes in less than quadratic time, vectorised over the whole batch; and the distance of
whole pages, by bit vectors.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import RARE_CHARS, column, length_bucket, let, normalize, only_rare, page_tokens, words

#: First code point that stands for a word, and how many follow.
WORD_BASE, MAX_WORDS = 0x10000, 0x100000


def edit_distance(a: Column | str, b: Column | str) -> Column:
    a, b = column(a), column(b)
    return (
        F.when(a == b, F.lit(0))
        .when(a == "", F.char_length(b))
        .when(b == "", F.char_length(a))
        .otherwise(F.levenshtein(a, b))
    )


def _over(number: Column, by: Column) -> Column:
    return number / F.greatest(F.lit(1), by)


def cer(ref: Column | str, hyp: Column | str) -> Column:
    """Character edits per reference character; the texts are taken as they are."""
    return _over(edit_distance(ref, hyp), F.char_length(column(ref)))


def _as_code_points(own: Column, all_words: Column) -> Column:
    """One code point per word: its number among the pair's distinct words."""
    code = lambda w: F.decode(
        F.unhex(F.lpad(F.hex(F.lit(WORD_BASE - 1) + F.array_position(all_words, w)), 8, "0")), "UTF-32"
    )
    return F.array_join(F.transform(own, code), "")


def word_distance(ref_words: Column, hyp_words: Column) -> Column:
    """Edit distance of word lists; a pair may have 1,048,576 different words, more raise an error."""

    def of_lists(p: Column) -> Column:
        coded = lambda q: F.struct(
            _as_code_points(q["p"]["r"], q["both"]).alias("r"), _as_code_points(q["p"]["h"], q["both"]).alias("h")
        )
        pair = F.struct(p.alias("p"), F.array_distinct(F.concat(p["r"], p["h"])).alias("both"))
        return let(
            pair,
            lambda q: F.when(F.size(q["both"]) <= MAX_WORDS, let(coded(q), lambda c: edit_distance(c["r"], c["h"]))).otherwise(
                F.raise_error(F.lit("too many different words in a pair")).cast("int")
            ),
        )

    return let(F.struct(ref_words.alias("r"), hyp_words.alias("h")), of_lists)


def bit_distance(a, b) -> int:
    """Edit distance of two sequences by bit vectors: a column of the matrix is two integers of len(a) bits."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, edits = full, 0, len(a)
    for x in b:
        same = where.get(x, 0)
        level = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (full ^ (level | plus) & full)
        down = plus & level
        edits += (up & top > 0) - (down & top > 0)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full ^ (same | minus | up) & full), up & (same | minus)
    return edits


def long_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance of long texts: an Arrow function that takes a word of bits where the matrix has cells.

    What two texts begin and end with alike is left out first.
    """

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            n = len(commonprefix((s, t)))
            s, t = s[n:], t[n:]
            m = len(commonprefix((s[::-1], t[::-1])))
            out.append(bit_distance(s[: len(s) - m], t[: len(t) - m]))
        return pd.Series(out, dtype="int32")

    return distance(column(a), column(b))


def wer(ref: Column | str, hyp: Column | str) -> Column:
    """Word edits per reference word."""
    r, h = words(ref), words(hyp)
    return _over(word_distance(r, h), F.size(r))


def wer_legacy(ref: Column | str, hyp: Column | str) -> Column:
    """Character edits of the words joined by U+0001, per reference word."""
    r, h = words(normalize(ref)), words(normalize(hyp))
    return _over(edit_distance(F.array_join(r, "\x01"), F.array_join(h, "\x01")), F.size(r))


def wer_page(ref: Column | str, hyp: Column | str) -> Column:
    """Word edits per reference word over lower-cased words without punctuation."""
    r, h = page_tokens(ref), page_tokens(hyp)
    return _over(word_distance(r, h), F.size(r))


def ned_similarity(ref: Column | str, hyp: Column | str) -> Column:
    longest = F.greatest(F.char_length(column(ref)), F.char_length(column(hyp)))
    return F.lit(1.0) - _over(edit_distance(ref, hyp), longest)


def exact_match(ref: Column | str, hyp: Column | str) -> Column:
    return (column(ref) == column(hyp)).cast("double")


def length_ratio(ref: Column | str, hyp: Column | str) -> Column:
    return _over(F.char_length(column(hyp)), F.char_length(column(ref)))


def rare_char_cer(ref: Column | str, hyp: Column | str, rare: str = RARE_CHARS) -> Column:
    """CER of the rare characters alone; null if the reference has none."""
    r, h = only_rare(ref, rare), only_rare(hyp, rare)
    return F.when(r != "", cer(r, h))


def bag_of_words(ref: Column | str, hyp: Column | str) -> Column:
    """struct(precision, recall, f1) of the bags of page words; two empty bags agree.

    The overlap is one pass over both bags' words in order.
    """
    tagged = lambda bag, side: F.transform(bag, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))

    def step(acc: Column, x: Column) -> Column:
        same = acc["w"].eqNullSafe(x["w"])
        done = acc["o"] + F.when(same, 0).otherwise(F.least(acc["a"], acc["b"]))
        count = lambda name, side: (F.when(same, acc[name]).otherwise(0) + (x["side"] == side).cast("int")).alias(name)
        return F.struct(x["w"].alias("w"), count("a", 0), count("b", 1), done.alias("o"))

    def scores(p: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("w"), *[F.lit(0).alias(c) for c in "abo"])
        overlap = F.aggregate(
            F.array_sort(F.concat(tagged(p["r"], 0), tagged(p["h"], 1))), start, step, lambda acc: acc["o"] + F.least(acc["a"], acc["b"])
        )
        return F.struct(overlap.alias("o"), F.size(p["r"]).alias("nr"), F.size(p["h"]).alias("nh"))

    def finish(n: Column) -> Column:
        precision, recall, none = _over(n["o"], n["nh"]), _over(n["o"], n["nr"]), (n["nr"] + n["nh"]) == 0
        f1 = F.when(n["o"] > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
        pick = lambda c, name: F.when(none, F.lit(1.0)).otherwise(c).alias(name)
        return F.struct(pick(precision, "precision"), pick(recall, "recall"), pick(f1, "f1"))

    bags = F.struct(page_tokens(ref).alias("r"), page_tokens(hyp).alias("h"))
    return let(let(bags, scores), finish)


def char_ngrams(text: Column | str, n: int) -> Column:
    """Character n-grams in order; a shorter text is one gram, an empty one has none."""

    def grams(low: Column) -> Column:
        last = F.greatest(F.lit(1), F.char_length(low) - n + 1)
        cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.char_length(low) == 0, F.array().cast("array<string>")).otherwise(cut)

    return let(F.lower(normalize(text)), grams)


# ---------------------------------------------------------------- chrF


def _gram_keys(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys of every row's n-grams, row marked in; row numbers)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(np.int64))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = np.concatenate([points, np.zeros(n, np.uint64)])
    row = np.repeat(np.arange(len(texts)), counts)
    start = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    left = np.repeat(lengths, counts)  # a gram of a short text takes what there is
    key = row.astype(np.uint64)
    for k in range(n):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        key += np.where(k < left, points[start + k] + np.uint64(1), np.uint64(0))
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32)), row


def chrf_batch(ref: list[str], hyp: list[str], beta: float = 1.0, max_n: int = 6) -> np.ndarray:
    """chrF of each pair: the mean over n of F_beta of multiset overlaps; two empty sides agree."""
    total, square = np.zeros(len(ref)), beta * beta
    for n in range(1, max_n + 1):
        (rk, rr), (hk, hr) = _gram_keys(ref, n), _gram_keys(hyp, n)
        ru, rfirst, rc = np.unique(rk, return_index=True, return_counts=True)
        hu, hc = np.unique(hk, return_counts=True)
        at = np.searchsorted(hu, ru)
        at[at == len(hu)] = 0
        both = np.where(hu[at] == ru, np.minimum(rc, hc[at]), 0) if len(hu) else np.zeros(len(ru))
        overlap = np.bincount(rr[rfirst], weights=both, minlength=len(ref))
        size_r = np.bincount(rr, minlength=len(ref))
        size_h = np.bincount(hr, minlength=len(ref))
        p, r = overlap / np.maximum(1, size_h), overlap / np.maximum(1, size_r)
        below = square * p + r
        score = np.divide((1 + square) * p * r, below, out=np.zeros(len(ref)), where=below > 0)
        total += np.where((size_r == 0) & (size_h == 0), 1.0, score)
    return total / max_n


def chrf(ref: Column | str, hyp: Column | str, beta: float = 1.0, max_n: int = 6) -> Column:
    """chrF over lower-cased texts, as an Arrow UDF over whole batches."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(chrf_batch(a.tolist(), b.tolist(), beta, max_n))

    return score(F.lower(normalize(ref)), F.lower(normalize(hyp)))


def positional_diff(ref: Column | str, hyp: Column | str) -> Column:
    """array<struct<index, reference, prediction, status>> of the texts laid side by side."""
    chars = lambda t: F.filter(F.split(column(t), ""), lambda c: c != "")
    none = F.lit("")
    pairs = F.zip_with(
        chars(ref), chars(hyp), lambda a, b: F.struct(F.coalesce(a, none).alias("r"), F.coalesce(b, none).alias("h"))
    )
    status = lambda d: (
        F.when(d["r"] == d["h"], "match").when(d["r"] == "", "inserted").when(d["h"] == "", "missing").otherwise("substitution")
    )
    return F.transform(
        pairs,
        lambda d, i: F.struct(
            i.alias("index"), d["r"].alias("reference"), d["h"].alias("prediction"), status(d).alias("status")
        ),
    )


def with_metrics(records, rare: str = RARE_CHARS, charset: str | None = None, latency: str | None = None, chrf_score: bool = True):
    """``records`` (reference, prediction, optional text_length_bucket) with a column per metric.

    Texts are normalised once; every other column reads the normalised ones.
    """
    given = F.col("text_length_bucket") if "text_length_bucket" in records.columns else F.lit(None).cast("string")
    rows = records.withColumn("ref_n", normalize("reference")).withColumn("hyp_n", normalize("prediction"))
    bucket = F.coalesce(F.nullif(given, F.lit("")), length_bucket("ref_n"))
    out = (
        rows.withColumn("edits", edit_distance("ref_n", "hyp_n"))
        .withColumn("ref_len", F.char_length("ref_n"))
        .withColumn("cer", _over(F.col("edits"), F.col("ref_len")))
        .withColumn("wer", wer("ref_n", "hyp_n"))
        .withColumn("rare_char_cer", rare_char_cer("ref_n", "hyp_n", rare))
        .withColumn("exact_match", exact_match("ref_n", "hyp_n"))
        .withColumn("bucket", bucket)
        .withColumn("length_ratio", length_ratio("ref_n", "hyp_n"))
        .withColumn("empty", (F.col("hyp_n") == "").cast("double"))
        .withColumn("too_short", (F.col("length_ratio") < 0.70).cast("double"))
        .withColumn("too_long", (F.col("length_ratio") > 1.30).cast("double"))
        .withColumn("latency_ms", F.col(latency).cast("double") if latency else F.lit(None).cast("double"))
    )
    if charset is not None:
        from .text import invalid_charset

        out = out.withColumn("invalid_charset", invalid_charset("hyp_n", charset).cast("double"))
    return out.withColumn("chrf", chrf("ref_n", "hyp_n")) if chrf_score else out
