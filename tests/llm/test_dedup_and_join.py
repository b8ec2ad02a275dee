import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexigauge.llm import components, exact_dedup, jaccard_join

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(FOLD)].append(r["doc_id"])
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out


@pytest.mark.parametrize("by_content", [False, True])
def test_identities_by_either_way(odd_documents, by_content):
    ids = exact_dedup.identities(odd_documents.select("doc_id", "text"), 64, by_content).collect()
    by_name = defaultdict(set)
    for r in ids:
        by_name[r["n_blocks"], r["name"]].add(bytes(r["sha"]))
    assert all(len(v) == 1 for v in by_name.values())
    assert len(by_name) == len({bytes(r["sha"]) for r in ids}) and len(ids) == odd_documents.count()


def test_exact_dedup(odd_documents):
    rows = exact_dedup.exact_dedup(odd_documents, block_bytes=100).collect()
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows)
    assert got == Counter(brute_dedup(odd_documents.collect()))
    assert Counter(r["text_sha256"] for r in rows if r["kept"]).most_common(1)[0][1] == 1
    assert len({r["text_sha256"] for r in rows}) == sum(r["kept"] for r in rows)
    assert exact_dedup.exact_dedup(odd_documents.limit(0)).count() == 0


def test_drop_exact_copies_keeps_columns(odd_documents):
    kept = exact_dedup.drop_exact_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == len({(r["text"] or "").translate(FOLD) for r in odd_documents.collect()})
    plain = exact_dedup.drop_exact_copies(odd_documents.where("doc_id is not null and doc_id <> 11"))
    assert {r["doc_id"] for r in plain.collect()} == {2, 3, 5, 6, 7, 9, 10, 12, 13, 14}


def brute_join(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(FOLD))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i]["doc_id"])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((r["doc_id"], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def joined(docs):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect())


def test_join_on_odd_rows(odd_documents):
    assert joined(odd_documents) == brute_join(odd_documents.collect())
    assert jaccard_join.jaccard_join(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_brute_force(spark, seed):
    """Near copies at all distances, chains, a passage that many share, short sets."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 2000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for k in range(25):
        base = [word() for _ in range(rnd.choice([3, 6, 8, 15, 40, 120]))]
        for _ in range(60 if k == 7 else rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = word()
            base = own if rnd.random() < 0.5 else base
            texts.append(" ".join(own + (passage if rnd.random() < 0.3 else [])))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert joined(docs) == brute_join(docs.collect())


def test_blocks_compare_what_hubs_leave_open():
    """Two components of a family become one where any of their members are similar."""
    import numpy as np
    import pyarrow as pa

    sets = [set(range(k, k + 100)) for k in (0, 5, 10, 15, 300)]
    rows = {"kind": 0, "side": 0}
    table = pa.table(
        {
            "cid": [0, 1, 2, 3, 4],
            "component": [0, 0, 2, 3, 4],
            "n": pa.array([100] * 5, pa.int32()),
            "tokens": [np.array(sorted(s), np.uint64).tobytes() for s in sets],
            **{c: pa.array([v] * 5, pa.int32()) for c, v in rows.items()},
        }
    )
    got = jaccard_join._compare_blocks(table).to_pylist()
    assert len(got) == 2 and {x for r in got for x in r.values()} <= {0, 1, 2, 3}
    a, b = [np.arange(5, dtype=np.uint64), np.arange(3, 9, dtype=np.uint64)], [np.arange(4, 7, dtype=np.uint64)]
    assert jaccard_join.overlaps(a, b).tolist() == [[1], [3]]


@pytest.mark.parametrize("bounds", [(1, 2), (2, 3), (3, 1000), (16, 1024)])
def test_similar_sets_share_a_signature(monkeypatch, bounds):
    """Whatever the classes: the prefixes of two sets at the threshold always meet."""
    import numpy as np

    from lexigauge.llm import textvec

    monkeypatch.setattr(jaccard_join, "CLASS_BOUNDS", bounds)
    rnd = np.random.default_rng(4)
    for n in [4, 5, 6, 7, 8, 9, 10, 11, 14, 19, 20, 33, 50, 100, 301, 700]:
        for _ in range(25 if n < 20 else 8):
            tokens = textvec.mix(rnd.integers(1, 1 << 60, 2 * n + 5).astype(np.uint64))
            holders = dict(zip(tokens.tolist(), rnd.integers(2, 8, len(tokens)).tolist(), strict=True))
            pool = tokens[: 2 * n + 5]
            a = pool[:n]
            drop = int(rnd.integers(0, n // 5 + 1))
            b = np.concatenate([a[drop:], pool[n : n + int(rnd.integers(0, max(1, n // 5 - drop + 1)))]])
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            sign = lambda s: jaccard_join.signatures(
                np.sort(s), np.array([holders[x] for x in np.sort(s).tolist()], "<u4"), len(s)
            )
            assert len(np.intersect1d(sign(a), sign(b))), (n, len(b), both)


@pytest.mark.parametrize("chunk", [8, components.CHUNK])
def test_components_of_long_paths_and_stars(spark, chunk):
    path = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (5, None), (5, 4)]
    random.Random(3).shuffle(path)
    links = spark.createDataFrame(path, "a bigint, b bigint").repartition(5)
    got = [(r["id"], r["component"]) for r in components.components(links, chunk).collect()]
    assert sorted(got) == [(k, 0) for k in range(61)] + [(k, 100) for k in range(100, 160)]
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), chunk).count() == 0


def test_connected_agrees_with_union_find():
    draw = random.Random(5)
    for n in (1, 5, 40, 400):
        edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randrange(1, 2 * n))]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        u, v = components.connected(*(np.array(side) for side in zip(*edges)))
        seen = {x for e in edges for x in e}
        assert dict(zip(u.tolist(), v.tolist())) == {x: find(x) for x in seen if find(x) != x}
