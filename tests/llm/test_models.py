import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexigauge.llm import language_id, license_scan, textvec, toxicity


@pytest.fixture(scope="module")
def two_languages(spark):
    rnd = random.Random(3)
    parts = {"en": "the and ing tion er re on".split(), "fr": "le que ment eau é è ou".split()}
    rows = []
    for k in range(400):
        lang = "en" if k % 2 else "fr"
        words = ["".join(rnd.choices(parts[lang], k=rnd.randint(1, 3))) for _ in range(rnd.randint(5, 400))]
        rows.append((k, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_on_held_out(two_languages):
    got = language_id.language_id(two_languages, 60).join(two_languages, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_tables_agree_with_the_network():
    rnd = np.random.default_rng(2)
    net = language_id.Net(["a", "b", "c"])
    texts = [bytes(rnd.integers(32, 255, n).tolist()) for n in (0, 1, 255, 256, 257, 1000)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    best, score = language_id.Scorer(net).texts(buf, off)
    for k, t in enumerate(texts):
        if not t:
            assert score[k] == 0
            continue
        x = language_id.windows_of(t)
        weight = np.full(len(x), 256.0)
        weight[-1] = len(t) - 256 * (len(x) - 1)
        mean = (net.forward(x)[0] * weight[:, None]).sum(0) / len(t)
        assert score[k] == pytest.approx(mean.max(), abs=0.002)


def test_gradients_match_differences():
    rnd = np.random.default_rng(5)
    net = language_id.Net(["a", "b"])
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    x, y = rnd.integers(0, language_id.BYTES, (6, 20)), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -np.log(net.forward(x)[0][np.arange(6), y]).mean()
    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[at], 1e-2
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=1e-4)


def test_language_of_odd_rows(odd_documents):
    got = language_id.language_id(odd_documents).collect()
    assert len(got) == odd_documents.count()
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    kept = language_id.confident(odd_documents)
    assert kept.columns == odd_documents.columns
    assert not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}
    assert language_id.language_id(odd_documents.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(1500):
        text = rnd.choices(words, k=rnd.randint(30, 150))
        toxic = int(k % 6 == 0)
        for _ in range(3 * toxic):
            text[rnd.randrange(len(text))] = rnd.choice(["grobian", "lump", "Schuft!"])
        rows.append((k, " ".join(text)))
        if k % 3 or toxic:
            labels.append((k, 1, toxic))
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_toxicity_on_held_out(labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["doc_id"] % 6 == 0]
    clean = [r["predicted"] for r in held if r["doc_id"] % 6]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.02
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_of_odd_rows(odd_documents, labelled):
    got = toxicity.toxicity(odd_documents.select("doc_id", "text", "kept", "name"), labelled[1]).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    none = labelled[1].limit(0)
    assert toxicity.toxicity(odd_documents, none).count() == odd_documents.count()
    assert toxicity.toxicity(odd_documents.limit(0), none).count() == 0


def test_tables_find_every_key():
    keys = textvec.mix(np.arange(1, 5000, dtype=np.uint64))
    table = toxicity.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(textvec.mix(np.arange(6000, 9000, dtype=np.uint64))) == -1).all()
    assert (toxicity.Table(keys[:0]).find(keys) == -1).all()


def test_separation_counts_ties_half():
    assert toxicity.separation(np.array([1.0, 1.0, 2.0, 0.0]), np.array([1.0, 0.0, 1.0, 0.0])) == pytest.approx(0.875)
    assert toxicity.fit_curve(np.array([0.0, 0.0]), np.array([1.0, 0.0]))[0] == 0.0


# ---------------------------------------------------------------- license scan


def normal(text):
    import re

    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute_scan(texts):
    found = set()
    for k, text in enumerate(texts):
        own = grams(normal(text or ""))
        for name, notice in license_scan.TEMPLATES:
            want = set(grams(normal(notice)))
            hits = [i for i, g in enumerate(own) if g in want]
            if any(len(set(own[i : i + len(want)]) & want) >= 0.8 * len(want) for i in hits):
                found.add((k, name))
    return found


def test_scan_against_brute_force(spark):
    rnd = random.Random(4)
    filler = lambda n: " ".join(f"f{rnd.randint(0, 500)}" for _ in range(n))
    texts = [None, "", " ", "Released", filler(3000)]
    for name, notice in license_scan.TEMPLATES:
        for _ in range(6):
            texts.append(filler(rnd.randint(0, 60)) + "\n" + notice.upper() + "\n" + filler(rnd.randint(0, 60)))
        words = notice.split()
        if len(words) > 12:
            words[1] = "changed"
        texts.append(filler(20) + " " + " ".join(words) + " " + filler(5))
        texts.append(" ".join(words[: len(words) // 2]))
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, license int")
    got = {(r["doc_id"], r["license"]) for r in license_scan.license_scan(docs).collect()}
    assert got == brute_scan(texts)


def test_scan_places_and_odd_rows(spark, odd_documents):
    notice = license_scan.TEMPLATES[4][1]
    docs = spark.createDataFrame([(1, f"a b c {notice} x y z {notice}")], "doc_id bigint, text string")
    r = next(r for r in license_scan.license_scan(docs).collect() if r["license"] == "GPL-2.0")
    assert (r["first_word"], r["n_places"], r["containment"]) == (3, 2, 1.0)
    assert license_scan.license_scan(odd_documents).count() == 0
    assert license_scan.license_scan(docs, []).count() == 0


def test_bands_guarantee_their_miss_rate():
    sizes = [1, 3, 8, 14, 40]
    for scale in license_scan.plan(sizes, 0.8, 1e-6):
        for k in scale.templates:
            held = int(np.ceil(0.8 * sizes[k]))
            similarity = held / (scale.window + sizes[k] - held)
            assert (1 - similarity) ** scale.bands <= 1e-6 and scale.stride >= sizes[k]
    assert len(pa.array([1])) == 1
