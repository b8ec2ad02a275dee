"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, of toxic and of ordinary labelled text, are compared by the difference of their
log-likelihoods per word. Each is an absolutely discounted bigram model over its class's word
model, and that backs off to the continuation counts of all documents, which both classes share. An
expression keeps counts of its own in the classes only where they differ significantly (two-proportion
z test over documents); everything else, rare expressions above all, is left to the shared counts
and so costs both models alike. Counts are of documents, so a text that repeats a word counts once.
Without that test the labelled texts are too few: what chance puts in a class outweighs what marks
it (README, with figures).

The order and the z level are those of a fixed few that separate a calibration fold best, and a
logistic curve fitted to that fold turns the difference into a score.

Counts are distributed: every task counts its own documents and Spark adds up. The labelled sample
has a documented bound per class; the shared counts cover all documents and grow with them. What
the scoring tasks get are the significant expressions, tens of thousands at the most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import staged

MAX_PER_CLASS = 10_000
FOLDS = 5
#: Documents of this remainder fit the logistic curve; those of remainder 0 are held out.
CALIBRATION = 1

#: Words are runs of letters, digits and bytes beyond ASCII.
BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
START = np.uint64(1)
#: Marks in place of a bigram's first word: a word alone, a context's bigrams, and the words of all texts.
ALONE, CONTEXT, TOTAL = np.uint64(0), np.uint64(2), np.uint64(3)
#: z levels that are tried, and the least number of texts for an expression to be tested.
LEVELS = (2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 10.0)
#: Orders that are tried: class counts of words alone, or of bigrams too.
ORDERS = (2, 1)
LEAST_TEXTS = 3
DISCOUNT = 0.75
REGISTERS = 4096
#: Bigrams that a task holds to drop repeated ones before they are shuffled.
HELD_PAIRS = 4_000_000


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text modulo five; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def labelled_sample(labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, toxic, fold) of about ``per_class`` labelled rows of each class, chosen by a hash of the id."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold_of(F.col("doc_id")))
    rows = rows.where("fold <> 0")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    keep = F.lit(False)
    for toxic, n in counts.items():
        part = int(min(1.0, per_class / n) * 1_000_003)
        keep = keep | ((F.col("toxic") == toxic) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part))
    return rows.where(keep)


def _bigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous word, word, bounds by text); a text's first word follows START."""
    w = textvec.words(buf, off, BREAKS)
    h = textvec.span_hashes(buf, w.starts, w.ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    n = np.diff(w.bounds)
    before[w.bounds[:-1][n > 0]] = START
    return before, h, w.bounds


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return textvec.mix(v * textvec.MIX_A + w)


def count_expressions(docs: DataFrame) -> DataFrame:
    """(v, w, tox, ordinary): in how many texts of each class w follows v, or occurs (v is ALONE).

    Rows of CONTEXT sum up the bigrams that w begins, and that of TOTAL the distinct words of all
    texts. Expressions of fewer than LEAST_TEXTS texts are only in those sums. ``docs`` has text and
    toxic.
    """

    def rows(v: np.ndarray, w: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
        _, first, inverse = np.unique(_pair(v, w), return_index=True, return_inverse=True)
        total = np.bincount(inverse, minlength=len(first))
        tox = np.bincount(inverse, weights=label, minlength=len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(v[first].view(np.int64)),
                pa.array(w[first].view(np.int64)),
                pa.array(tox),
                pa.array((total - tox).astype(np.int64)),
            ],
            names=["v", "w", "tox", "ordinary"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in textvec.chunks(batch.column("text"), 8 << 20):
                v, w, bounds = _bigrams(buf, off)
                text = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(bounds))
                for before in (v, np.full(len(w), ALONE)):
                    # once for each text, then over the texts of the chunk
                    _, once = np.unique(_pair(_pair(before, w), text), return_index=True)
                    label = toxic[lo:hi][text[once].astype(np.int64)]
                    yield rows(before[once], w[once], label)
                    if before is v:
                        yield rows(np.full(len(once), CONTEXT), v[once], label)
                    else:
                        yield rows(np.full(len(once), TOTAL), np.full(len(once), ALONE), label)

    counted = docs.select("text", "toxic").mapInArrow(run, "v bigint, w bigint, tox bigint, ordinary bigint")
    counted = counted.groupBy("v", "w").agg(F.sum("tox").alias("tox"), F.sum("ordinary").alias("ordinary"))
    return counted.where((F.col("tox") + F.col("ordinary") >= LEAST_TEXTS) | (F.col("v") == int(TOTAL)))


class Table:
    """Row numbers by 64-bit key, looked up for whole arrays.

    Keys that find their place taken go to a further table; an empty place ends a search.
    """

    def __init__(self, keys: np.ndarray):
        self.levels = []
        rows = np.arange(len(keys), dtype=np.int32)
        while len(rows):
            bits = max(4, int(np.ceil(np.log2(4 * len(rows)))))
            factor = np.uint64(2 * len(self.levels) + 0x9E3779B97F4A7C15 | 1)
            at = ((keys[rows] * factor) >> np.uint64(64 - bits)).astype(np.int64)
            place = np.full(1 << bits, -1, np.int32)
            place[at] = rows
            held = np.zeros(1 << bits, np.uint64)
            held[place >= 0] = keys[place[place >= 0]]
            self.levels.append((bits, factor, held, place))
            rows = rows[place[at] != rows]

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        left = None
        for bits, factor, held, place in self.levels:
            k = keys if left is None else keys[left]
            at = ((k * factor) >> np.uint64(64 - bits)).astype(np.int64)
            row = place[at]
            hit = (row >= 0) & (held[at] == k)
            if left is None:
                out[hit] = row[hit]
                left = np.flatnonzero((row >= 0) & ~hit)
            else:
                out[left[hit]] = row[hit]
                left = left[(row >= 0) & ~hit]
            if not len(left):
                break
        return out


@dataclass
class Model:
    """Log-likelihood differences of words, of contexts (by their back-off weight) and of bigrams."""

    words: np.ndarray
    word: np.ndarray  # one more row than words: any other word
    context: np.ndarray  # likewise
    pairs: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    tables: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def differences(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-likelihood difference, words) per text; 0 without words."""
        v, w, bounds = _bigrams(buf, off)
        return self.of_bigrams(v, w, bounds), np.diff(bounds)

    def of_bigrams(self, v: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(w):
            return np.zeros(len(bounds) - 1)
        if self.tables is None:
            self.tables = Table(self.words), Table(self.pairs)
        row, both = self.tables[0].find(w), self.tables[1].find(_pair(v, w))
        before = np.empty_like(row)
        before[1:] = row[:-1]
        n = np.diff(bounds)
        before[bounds[:-1][n > 0]] = self.tables[0].find(np.array([START]))[0]
        diff = self.word[row] + self.context[before]
        direct = both >= 0
        diff[direct] = self.pair[both[direct]]
        upto = np.concatenate([[0.0], np.cumsum(diff, dtype=np.float64)])
        return (upto[bounds[1:]] - upto[bounds[:-1]]) / np.maximum(n, 1)


def _z(a, b, n_a: int, n_b: int):
    """Two-proportion z statistic of a of n_a against b of n_b texts; numbers, arrays or Columns."""
    p = (a + b) / (n_a + n_b)
    square = (a / n_a - b / n_b) ** 2 / (p * (1 - p) + 1e-12) / (1 / n_a + 1 / n_b)
    return square


def shared_counts(docs: DataFrame, words: np.ndarray) -> tuple[dict[int, int], float]:
    """(distinct predecessors of each of ``words``, estimated distinct bigrams) over all ``docs`` (text)."""
    table = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, registers = Table(table.value), np.zeros(REGISTERS, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def distinct() -> list[tuple[np.ndarray, np.ndarray]]:
            w, v = (np.concatenate(x) for x in zip(*held, strict=True))
            first = np.unique(_pair(v, w), return_index=True)[1]
            return [(w[first], v[first])]

        def rows() -> pa.RecordBatch:
            w, v = held[0]
            return pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)), pa.array(v.view(np.int64)), pa.nulls(len(w), pa.int64())], names=["w", "v", "rank"]
            )

        for batch in batches:
            for _, _, buf, off in textvec.chunks(batch.column("text"), 8 << 20):
                v, w, _ = _bigrams(buf, off)
                key = _pair(v, w)
                rank = 53 - np.frexp((key & np.uint64((1 << 52) - 1)).astype(np.float64))[1]
                np.maximum.at(registers, (key >> np.uint64(52)).astype(np.int64), rank)
                mine = wanted.find(w) >= 0
                held.append((w[mine], v[mine]))
                size += int(mine.sum())
                if size >= HELD_PAIRS:
                    held = distinct()
                    if len(held[0][0]) >= HELD_PAIRS // 2:
                        yield rows()
                        held = []
                    size = len(held[0][0]) if held else 0
        if held:
            held = distinct()
            yield rows()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(REGISTERS, pa.int64()), pa.array(np.arange(REGISTERS)), pa.array(registers)], names=["w", "v", "rank"]
        )

    seen = docs.select("text").mapInArrow(run, "w bigint, v bigint, rank bigint")
    seen = seen.groupBy("w", "v").agg(F.max("rank").alias("rank")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.expr("pow(2.0, -rank)")).alias("s"),
        F.sum((F.col("rank") == 0).cast("int")).alias("z"),
    )
    counts, top = {}, {"s": None}
    for r in seen.toLocalIterator():
        if r["w"] is None:  # the registers
            top = r
        else:
            counts[r["w"]] = r["n"]
    if top["s"] is None:
        return counts, 1.0
    estimate = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2 / top["s"]
    if top["z"] and estimate < 2.5 * REGISTERS:
        estimate = REGISTERS * np.log(REGISTERS / top["z"])
    return counts, float(max(estimate, 1.0, sum(counts.values())))


def fit_models(docs: DataFrame, labelled: DataFrame) -> list[Model]:
    """A model for each order and z level, from ``labelled`` (text, toxic) and the shared counts of all ``docs``."""
    grams = staged(count_expressions(labelled), "toxic-expressions")
    texts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_t, n_o = max(1, texts.get(1, 0)), max(1, texts.get(0, 0))
    differ = (F.col("tox") + F.col("ordinary") >= LEAST_TEXTS) & (
        _z(F.col("tox"), F.col("ordinary"), n_t, n_o) >= min(LEVELS) ** 2
    )
    special = [int(CONTEXT), int(TOTAL)]
    found = grams.where(differ & ~F.col("v").isin(special)).orderBy("v", "w").toArrow().to_pandas()
    alone = found[found.v == int(ALONE)]
    both = found[found.v != int(ALONE)]
    total = grams.where(F.col("v") == int(TOTAL)).first()
    size = {c: max(1, total[c] if total else 0) for c in ("tox", "ordinary")}
    # a significant bigram is of LEAST_TEXTS texts, and so its context is among the rows that were kept
    contexts = grams.where(F.col("v") == int(CONTEXT)).join(
        F.broadcast(grams.where(differ & ~F.col("v").isin([int(ALONE), *special])).select(F.col("v").alias("c")).distinct()),
        F.col("w") == F.col("c"),
        "left_semi",
    )
    after = {r["w"]: (r["tox"], r["ordinary"]) for r in contexts.toLocalIterator()}
    words = np.unique(np.concatenate([alone.w.to_numpy(), both.w.to_numpy(), both.v.to_numpy()]).astype(np.int64))
    # contexts alone need no probability of their own
    ends = np.unique(np.concatenate([alone.w.to_numpy(), both.w.to_numpy()]).astype(np.int64))
    before, types = shared_counts(docs, ends.view(np.uint64))
    shared = np.array([before.get(int(w), 0) + 1 for w in words], np.float64) / (types + len(words) + 1)
    models = []
    for order, level in ((o, z) for o in ORDERS for z in LEVELS):
        mine = alone[_z(alone.tox, alone.ordinary, n_t, n_o) >= level**2]
        pairs = both[(_z(both.tox, both.ordinary, n_t, n_o) >= level**2) & (order > 1)]
        at = np.searchsorted(words, mine.w.to_numpy())
        p, rest = {}, {}
        for c in ("tox", "ordinary"):
            kept = np.zeros(len(words))
            kept[at] = np.maximum(mine[c].to_numpy() - DISCOUNT, 0) / size[c]
            rest[c] = max(1e-3, 1 - kept.sum())
            p[c] = kept + rest[c] * shared
        word = np.append(np.log(p["tox"]) - np.log(p["ordinary"]), np.log(rest["tox"] / rest["ordinary"]))
        v, w = np.searchsorted(words, pairs.v.to_numpy()), np.searchsorted(words, pairs.w.to_numpy())
        direct, weight = {}, {}
        for k, c in enumerate(("tox", "ordinary")):
            total = np.array([after[int(x)][k] for x in pairs.v], np.float64)
            kept = np.maximum(pairs[c].to_numpy() - DISCOUNT, 0) / np.maximum(total, 1)
            weight[c] = np.maximum(1e-3, 1 - np.bincount(v, weights=kept, minlength=len(words)))
            direct[c] = kept + weight[c][v] * p[c][w]
        context = np.append(np.log(weight["tox"]) - np.log(weight["ordinary"]), 0.0)
        pair = np.log(direct["tox"]) - np.log(direct["ordinary"])
        keys = _pair(pairs.v.to_numpy(np.int64).view(np.uint64), pairs.w.to_numpy(np.int64).view(np.uint64))
        models.append(Model(words.view(np.uint64), word, context, keys, pair))
    return models


def separation(diff: np.ndarray, toxic: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.unique(diff, return_inverse=True)[1]
    count = np.bincount(order)
    rank = (np.cumsum(count) - (count - 1) / 2)[order]
    n = toxic.sum()
    return float((rank[toxic == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(toxic) - n)))


def fit_curve(diff: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve: Newton's method with a unit ridge on the standardised slope.

    With one class only, differences that are all alike or that point the wrong way, the slope is 0
    and the shift is that of the class shares, half a document added to each.
    """
    base = float(np.log((toxic.sum() + 0.5) / ((1 - toxic).sum() + 0.5)))
    scale = float(diff.std()) if len(diff) else 0.0
    if scale < 1e-9 or toxic.min() == toxic.max():
        return 0.0, base
    x = np.stack([diff / scale, np.ones(len(diff))], 1)
    beta, ridge = np.array([0.0, base]), np.diag([1.0, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.clip(np.linalg.solve(curve, x.T @ (toxic - p) - ridge @ beta), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0]) / scale, float(beta[1])) if beta[0] > 0 else (0.0, base)


def measure(docs: DataFrame, models: list[Model]) -> DataFrame:
    """The columns of ``docs`` but its text, ``words`` and for each model ``diff0``, ``diff1``, ..."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    others = [f for f in docs.schema.fields if f.name != "text"]
    added = [f"diff{k}" for k in range(len(models))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in textvec.chunks(batch.column("text")):
                v, w, bounds = _bigrams(buf, off)
                own = [batch.column(f.name).slice(lo, hi - lo) for f in others]
                found = [pa.array(m.of_bigrams(v, w, bounds)) for m in shared.value]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(np.diff(bounds), pa.int64()), *found], names=[*[f.name for f in others], "words", *added]
                )

    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in others] + ["words bigint"] + [f"{a} double" for a in added])
    return docs.select(*[f.name for f in others], "text").mapInArrow(run, ddl)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Model:
    """Counts from the labelled sample's other folds; order, z level and curve from its calibration fold."""
    docs = docs.select("doc_id", "text").where("text is not null")
    sample = F.broadcast(labelled_sample(labels, per_class))  # bounded by about 2 x per_class rows
    rows = docs.join(sample, "doc_id")
    models = fit_models(docs, rows.where(F.col("fold") != CALIBRATION).select("text", "toxic"))
    seen = measure(rows.where(F.col("fold") == CALIBRATION).select("toxic", "text"), models).where("words > 0").toArrow()
    toxic = seen["toxic"].to_numpy().astype(np.float64)
    diffs = [seen[f"diff{k}"].to_numpy().astype(np.float64) for k in range(len(models))]
    best = max(range(len(models)), key=lambda k: (round(separation(diffs[k], toxic), 4), k))
    model = models[best]
    model.slope, model.shift = fit_curve(diffs[best], toxic)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, toxic) outside the held-out fold, from about ``per_class`` rows
    of each class at most. A text without words has a difference of 0 and the score of that; null
    text is such a text. With no labels, or one class, every score is that of a difference of 0.
    A document labelled twice counts as toxic if one label says so. Repeated rows and
    null ids come back one for one; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, per_class)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text"
    )
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("diff0") * model.slope + model.shift)))
    return (
        measure(rows, [model])
        .withColumn("score", score)
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
