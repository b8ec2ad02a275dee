import random

import numpy as np

from lexigauge.functions.metrics import bit_distance
from lexigauge.operators import edit_operations as E
from lexigauge.operators import inference


def plain(ref, hyp):
    """Edits by the whole matrix, the tie rule read off it."""
    cost = [[max(i, j) if not i * j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]))
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            if ref[i] != hyp[j]:
                out.append(("sub", i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("del", i, j))
        else:
            j -= 1
            out.append(("ins", i, j))
    return out[::-1], cost[-1][-1]


def pairs(n=150):
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choices("abcé ", k=rnd.randint(0, k)))
    return [(word(30), word(30)) for _ in range(n)] + [("", ""), ("", "abc"), ("abc", ""), ("same", "same")]


def stripped(ref, hyp):
    """The common beginning is never edited."""
    n = 0
    while n < min(len(ref), len(hyp)) and ref[n] == hyp[n]:
        n += 1
    return [(op, i + n, j + n) for op, i, j in plain(ref[n:], hyp[n:])[0]]


def test_alignment_equals_the_whole_matrix(monkeypatch):
    rows = pairs()
    together = E.align_all([r for r, _ in rows], [h for _, h in rows])
    for k, (r, h) in enumerate(rows):
        own = together[0] == k
        got = [(E.NAMES[o], i, j) for o, i, j in zip(*[c[own].tolist() for c in together[1:]], strict=True)]
        assert got == stripped(r, h) == E.align(r, h)
    monkeypatch.setattr(E, "CELLS", 1)
    assert [E.align(r, h) for r, h in rows] == [stripped(r, h) for r, h in rows]


def test_counts_are_those_of_the_alignment(monkeypatch):
    rnd = random.Random(8)
    long = lambda: "".join(rnd.choices("ab\U0001f600", k=rnd.randint(0, 600)))
    rows = pairs(400) + [(long(), long()) for _ in range(30)] + [("abc", "abc abc"), ("x" + "a" * 40, "a" * 40 + "x")]
    refs, hyps = [r for r, _ in rows], [h for _, h in rows]
    pair, op, _, _ = E.align_all(refs, hyps)
    want = [np.bincount(pair[op == o], minlength=len(rows)).tolist() for o in (E.DEL, E.SUB, E.INS)]
    assert E.count_all(refs, hyps).tolist() == want
    for name in ("CHARS", "DIAGONAL"):
        monkeypatch.setattr(E, name, 1)
        assert E.count_all(refs, hyps).tolist() == want
    assert E.count_all([], []).shape == (3, 0)


def test_only_what_differs_gets_a_matrix(monkeypatch):
    seen, whole = [], E._align_together
    monkeypatch.setattr(E, "_align_together", lambda a, b: seen.extend((len(x), len(y)) for x, y in zip(a, b, strict=True)) or whole(a, b))
    assert E.align("say hello twice", "say hullo twice") == [("sub", 5, 5)] and seen == [(1, 1)]
    assert E.align("abc", "abxc") == [("ins", 2, 2)] and E.align("ab", "") == [("del", 0, 0), ("del", 1, 0)] and len(seen) == 1


def test_pairs_are_aligned_once_for_all_sums(spark):
    schema = "reference string, prediction string, kind string, page long"
    rows = spark.createDataFrame([("abc", "axcd", "x", 1), ("  b  c", "b", None, 1), ("d", "", "x", 2), (None, "é", "y", None)], schema)
    by_all = lambda some: E.tallies_by_all(some, ["kind", "page"])
    got = by_all(E.edit_counts(rows))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_all(E.edit_operations(rows)).collect()))
    sums = {(r["dimension"], r["value"]): tuple(r[c] for c in E.SUMS) for r in got.collect()}
    assert sums == {
        ("overall", "all"): (4, 7, 3, 1, 2), ("kind", "x"): (2, 4, 1, 1, 1), ("kind", "unknown"): (1, 3, 2, 0, 0), ("kind", "y"): (1, 0, 0, 0, 1),
        ("page", "1"): (2, 6, 2, 1, 1), ("page", "2"): (1, 1, 1, 0, 0), ("page", "unknown"): (1, 0, 0, 0, 1),
    }
    assert [tuple(r) for r in by_all(E.edit_counts(rows.limit(0))).collect()] == [("overall", "all", 0, *[None] * 9)]


def test_bit_distance_equals_the_matrix():
    for r, h in pairs():
        assert bit_distance(r, h) == plain(r, h)[1]
    words = lambda t: t.split(" ")
    assert all(bit_distance(words(r), words(h)) == plain(words(r), words(h))[1] for r, h in pairs())


def test_texts_of_outputs():
    class Box:
        text = ["x", {"content": "y"}]

    assert inference.text_of([{"rec_text": "a", "text": ""}, ["b", None], {"k": {"text": "c"}, "n": 3}]) == "a\nb\nc"
    assert inference.text_of(Box()) == "x\ny" and inference.text_of(None) == "" and inference.text_of(7) == "7"


def test_timeouts_and_whole_batches(spark):
    def make():
        import time

        def model(images, prompts):
            if "slow" in images:
                time.sleep(5 if len(images) == 1 else 0)
                raise RuntimeError("slow")
            return [i.upper() for i in images]

        return model

    rows = spark.createDataFrame([("a", None), ("slow", None)], "image_url string, prompt string").coalesce(1)
    got = {r["image_url"]: r for r in inference.predict(rows, make, timeout=0.5, marks=True).collect()}
    assert got["a"]["prediction"] == "A" and got["slow"]["prediction"] == "[TIMEOUT]" and "0.5 seconds" in got["slow"]["error"]
    whole = inference.predict(rows, make, retry=False, marks=True).collect()
    assert {r["prediction"] for r in whole} == {"[FAILED]"}
