"""Language identification by a byte convolutional network, trained and applied in numpy.

The network looks at fixed-length windows of a text's bytes as they are: byte embeddings, filters of
several widths, the maximum of each filter over the window, softmax. Training is a driver-side job on
a sample of windows whose size is a parameter; scoring runs over every window of every text.

Scoring never multiplies matrices over the text. A filter's response is a sum of what each of its
bytes adds, so it is a sum of table rows, one for each pair of bytes (and one for a single byte at an
odd width). The rows are quantised to integers of one scale per filter, so they can be added up, and
quantising keeps order and so commutes with the maximum. A pair's table has 65,536 rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import lean

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 12
BYTES = 256
#: Labelled rows taken for training, per language, and windows out of all of theirs.
SAMPLE_PER_LANG = 400
WINDOWS_PER_LANG = 4000
UNKNOWN = "und"
FOLDS = 4
HELD = 2
#: What stands behind the end of a text.
BLANK = 32
#: Windows that are scored at a time: their responses should fit a processor's cache.
AT_ONCE = 256


def held_out(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``held``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


class Net:
    """Embedding, filters by width, output weights; languages in sorted order."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.3, (BYTES, EMBED)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters.values(), *self.bias.values(), self.out, self.out_bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        e, pooled, kept = self.embed[x], [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            r = sum(e[:, k : n + k] @ self.filters[w][k] for k in range(w)) + self.bias[w]
            at = r.argmax(1)
            top = np.take_along_axis(r, at[:, None, :], 1)[:, 0]
            pooled.append(np.tanh(top))
            kept.append((w, at))
        h = np.concatenate(pooled, 1)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), [e, kept, h]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p, (e, kept, h) = self.forward(x)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g_out, g_bias = h.T @ d, d.sum(0)
        dh = (d @ self.out.T) * (1 - h**2)
        g_embed, g_filters, g_fbias = np.zeros_like(self.embed), [], []
        rows = np.arange(len(y))[:, None]
        for k, (w, at) in enumerate(kept):
            dt = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g = np.zeros_like(self.filters[w])
            for j in range(w):
                seen = e[rows, at + j]  # examples x filters x embedding
                g[j] = np.einsum("nfe,nf->ef", seen, dt)
                np.add.at(g_embed, x[rows, at + j], dt[:, :, None] * self.filters[w][j].T[None])
            g_filters.append(g)
            g_fbias.append(dt.sum(0))
        return [g_embed, *g_filters, *g_fbias, g_out, g_bias]


def windows_of(text: bytes, window: int = WINDOW) -> np.ndarray:
    """The text's bytes in rows of ``window``, the last padded."""
    own = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(own) // window))
    out = np.full(n * window, BLANK, np.uint8)
    out[: len(own)] = own
    return out.reshape(n, window)


def train(texts: list[bytes], langs: list[str], window: int = WINDOW, steps: int = 500, seed: int = 7) -> Net:
    """Adam on random windows, each language equally often. The same input gives the same net."""
    known = sorted(set(langs))
    net = Net(known, seed)
    if len(known) < 2:
        return net
    rng = np.random.default_rng(seed)
    pools = {k: [windows_of(t, window) for t, own in zip(texts, langs, strict=True) if own == k] for k in known}
    pools = {k: np.concatenate(v) for k, v in pools.items()}
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    per = max(4, 64 // len(known))
    for step in range(1, steps + 1):
        x = np.concatenate([pools[k][rng.integers(0, len(pools[k]), per)] for k in known])
        y = np.repeat(np.arange(len(known)), per)
        # some windows are cut short, as those at the end of a text and those of short texts are
        short = rng.random(len(x)) < 0.3
        ends = rng.integers(8, window, len(x))
        x = np.where(short[:, None] & (np.arange(window)[None] >= ends[:, None]), np.uint8(BLANK), x)
        rate = 0.01 * (1 - step / (steps + 1))
        for p, g, a, b in zip(params, net.gradients(x, y), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """The net as lookup tables: for each width what every pair of bytes adds, and a last single byte."""

    def __init__(self, net: Net):
        self.langs, self.out, self.out_bias = net.langs, net.out, net.out_bias
        self.tables, self.scale = {}, {}
        for w in WIDTHS:
            single = [net.embed @ net.filters[w][k] for k in range(w)]
            low = sum(t.min(0) for t in single)
            step = np.maximum((sum(t.max(0) for t in single) - low) / 30_000, 1e-9)
            parts = []
            for k in range(0, w, 2):
                t = single[k] - single[k].min(0)
                if k + 1 < w:
                    t = (t[:, None, :] + (single[k + 1] - single[k + 1].min(0))[None, :, :]).reshape(-1, FILTERS)
                parts.append(np.round(t / step).astype(np.int16))
            self.tables[w] = parts
            self.scale[w] = (low + net.bias[w], step)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of each row of bytes."""
        pair = x[:, :-1].astype(np.uint16) << np.uint16(8) | x[:, 1:]
        pooled = []
        for w in WIDTHS:
            n, seen = x.shape[1] - w + 1, None
            for k, table in enumerate(self.tables[w]):
                code = pair if len(table) > BYTES else x
                part = table.take(code[:, 2 * k : 2 * k + n], axis=0)
                seen = part if seen is None else np.add(seen, part, out=seen)
            low, step = self.scale[w]
            pooled.append(np.tanh(low + step * _highest(seen)))
        z = np.concatenate(pooled, 1) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def texts(self, buf: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(language number, probability) per text: the mean over its windows, weighted by their bytes."""
        n = np.diff(off)
        counts = -(-n // window)
        total = int(counts.sum())
        mean = np.zeros((len(n), len(self.langs)))
        if total:
            first = np.cumsum(counts) - counts
            x = np.full(total * window, BLANK, np.uint8)
            x[textvec.positions(first * window, n)] = buf
            x = x.reshape(total, window)
            weight = np.full(total, window, np.float64)
            some = counts > 0
            weight[(first + counts - 1)[some]] = (n - (counts - 1) * window)[some]
            p = np.concatenate([self.windows(x[k : k + AT_ONCE]) for k in range(0, total, AT_ONCE)]) * weight[:, None]
            mean[some] = np.add.reduceat(p, first[some]) / n[some][:, None]
        best = mean.argmax(1)
        return best, mean[np.arange(len(n)), best]


def _highest(seen: np.ndarray) -> np.ndarray:
    """The maximum along the middle axis, by halves: whole rows are compared at a time."""
    while (n := seen.shape[1]) > 1:
        half = n // 2
        top = np.maximum(seen[:, :half], seen[:, half : 2 * half])
        if n % 2:
            np.maximum(top[:, :1], seen[:, 2 * half :], out=top[:, :1])
        seen = top
    return seen[:, 0]


@lru_cache(maxsize=2)
def _scorer(pickled: bytes) -> Scorer:
    """The tables are made once for each worker; only the small net travels."""
    return Scorer(pickle.loads(pickled))


def training_sample(
    docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, windows: int = WINDOWS_PER_LANG
) -> tuple[list[bytes], list[str]]:
    """(windows, their languages) of about ``per_lang`` labelled rows of each language, chosen by a hash.

    Of all windows of a language's rows, those with the lowest hashes come to the driver, ``windows`` at most.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    pieces = F.ceil(F.octet_length("text") / WINDOW).cast("int")
    known = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(pieces).alias("w")).collect()}
    if not known:
        return [], []
    # the shares that give so many rows, and so many windows of these; a margin, then the lowest hashes
    row_share = {k: min(1.0, per_lang / r["n"]) for k, r in known.items()}
    share = {k: min(1.0, 1.3 * windows / max(1.0, r["w"] * row_share[k])) for k, r in known.items()}
    most = lambda shares: F.create_map(*[F.lit(x) for k, s in shares.items() for x in (k, s)])[F.col("lang")] * 1_000_003
    drawn = lambda *what: F.pmod(F.xxhash64(*what), F.lit(1_000_003))
    rows = rows.where(drawn(F.col("doc_id"), F.col("lang"), F.length("text")) < most(row_share))
    raw = F.col("text").cast("binary")
    cut = rows.select(
        "lang", F.explode(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(raw, i * WINDOW + 1, F.lit(WINDOW)))).alias("piece")
    ).withColumn("rank", F.xxhash64("piece"))
    taken: dict[str, list] = {k: [] for k in known}
    for r in cut.where(drawn(F.col("rank")) < most(share)).toLocalIterator():
        taken[r["lang"]].append((r["rank"], bytes(r["piece"])))
    pairs = [(t, k) for k, v in sorted(taken.items()) for _, t in sorted(v)[:windows]]
    return [t for t, _ in pairs], [k for _, k in pairs]


def identify(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text); see ``language_id``."""
    pickled = pickle.dumps(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(pickled)
        names = np.array([*scorer.langs, UNKNOWN], dtype=object)
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in textvec.chunks(batch.column("text"), 1 << 20):
                best, score = scorer.texts(buf, off)
                known = letters[lo:hi].astype(bool) & (len(scorer.langs) > 0)
                best = np.where(known, best, len(scorer.langs))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        batch.column("held_out").slice(lo, hi - lo),
                        pa.array(names[best], pa.string()),
                        pa.array(np.where(known, np.clip(score, 0, 1), 0.0)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        held_out(F.col("doc_id")).alias("held_out"),
        _letters().alias("letters"),
    )
    return rows.mapInArrow(lean(run), "doc_id bigint, held_out boolean, lang_pred string, score double")


def _letters() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def language_id(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text, lang).

    Trained on windows of about ``per_lang`` rows of each language outside the held-out fold (crc32 of
    the id modulo 4 is 2). Null text, and text without a letter, is ``und`` with score 0, and so is all text
    when no row is labelled; with one language everything else is that language. Every window of a
    text counts, whatever its length. Repeated rows and null ids come back one for one; an empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    return identify(docs, train(*training_sample(docs, per_lang)))


def confident(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text is some known language with a score of ``least`` at least.

    Rows are scored and kept or dropped where they are: each goes by its own text, whatever other rows
    its id has, and nothing is shuffled.
    """
    pickled = pickle.dumps(train(*training_sample(docs)))
    names = docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(pickled)
        for batch in batches:
            letters = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, off in textvec.chunks(batch.column(text), 1 << 20):
                keep = letters[lo:hi] & (len(scorer.langs) > 0)
                if keep.any():
                    keep &= scorer.texts(buf, off)[1] >= least
                own = [c.slice(lo, hi - lo) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays(own, names=names).filter(pa.array(keep))

    return docs.withColumn("_letters_", _letters()).mapInArrow(lean(run), docs.schema)
