"""The toxicity model against the same formulas on dictionaries, expression by expression."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexigauge.llm import textvec, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(300):
        own = rnd.choices(words, k=rnd.randint(5, 40))
        if k % 4 == 0:
            at = rnd.randrange(len(own))
            own[at : at + 1] = rnd.choice([["bad", "thing"], ["lump"], ["bad"]])
        elif rnd.random() < 0.3:
            own.insert(rnd.randrange(len(own)), "thing")
        texts.append((" ".join(own), int(k % 4 == 0)))
    return texts, spark.createDataFrame([(t,) for t, _ in texts], "text string"), spark.createDataFrame(texts, "text string, toxic int")


def plain_models(texts):
    """For each order and level: the mean log-likelihood difference of a text."""
    bigrams = lambda t: list(zip(["<s>", *re.findall(r"[A-Za-z0-9]+", t)], re.findall(r"[A-Za-z0-9]+", t), strict=False))
    n = [sum(y == c for _, y in texts) for c in (0, 1)]
    word, pair, after = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    before, size = defaultdict(set), [0, 0]
    for t, y in texts:
        for w in {w for _, w in bigrams(t)}:
            word[w][y] += 1
            size[y] += 1
        for v, w in set(bigrams(t)):
            pair[v, w][y] += 1
            after[v][y] += 1
            before[w].add(v)
    types = sum(map(len, before.values()))

    def square(c):
        p = (c[1] + c[0]) / sum(n)
        return (c[1] / n[1] - c[0] / n[0]) ** 2 / (p * (1 - p) + 1e-12) / (1 / n[1] + 1 / n[0])

    tested = lambda counts, z: {k: c for k, c in counts.items() if sum(c) >= toxicity.LEAST_TEXTS and square(c) >= z * z}
    least = min(toxicity.LEVELS)
    ends = set(tested(word, least)) | {w for _, w in tested(pair, least)}
    known = ends | {v for v, _ in tested(pair, least)}
    shared = {w: (len(before[w]) if w in ends else 0) + 1 for w in known}
    for order in toxicity.ORDERS:
        for z in toxicity.LEVELS:
            own, both = tested(word, z), tested(pair, z) if order > 1 else {}
            rest = [max(1e-3, 1 - sum(max(c[y] - toxicity.DISCOUNT, 0) / size[y] for c in own.values())) for y in (0, 1)]
            kept = defaultdict(lambda: [0.0, 0.0])
            for (v, _), c in both.items():
                for y in (0, 1):
                    kept[v][y] += max(c[y] - toxicity.DISCOUNT, 0) / max(after[v][y], 1)

            def log(v, w, y, own=own, both=both, rest=rest, kept=kept):
                # a word that no expression names has the same shared probability in both classes
                back = shared.get(w, 1) / (types + len(known) + 1)
                p = (max(own[w][y] - toxicity.DISCOUNT, 0) / size[y] if w in own else 0) + rest[y] * back
                weight = max(1e-3, 1 - kept[v][y]) if v in kept else 1.0
                direct = max(both[v, w][y] - toxicity.DISCOUNT, 0) / max(after[v][y], 1) if (v, w) in both else 0
                return math.log(direct + weight * p)

            yield lambda t, log=log: sum(log(v, w, 1) - log(v, w, 0) for v, w in bigrams(t)) / max(1, len(bigrams(t)))


def test_models_equal_plain_formulas(corpus):
    texts, docs, labelled = corpus
    models = toxicity.fit_models(docs, labelled)
    asked = [t for t, _ in texts[:60]] + ["", "bad thing", "never seen words"]
    _, _, buf, off = next(textvec.chunks(pa.array(asked, pa.string())))
    for model, plain in zip(models, plain_models(texts), strict=True):
        got = model.differences(buf, off)[0]
        # the number of distinct bigrams is an estimate (4096 registers)
        assert np.allclose(got, [plain(t) for t in asked], atol=0.02), (got[:5], [plain(t) for t in asked[:5]])
