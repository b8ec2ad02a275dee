import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from lexigauge.llm import bpe, packing, textvec
from lexigauge.llm.queries import vocabulary

PATTERN = regex.compile(public.PATTERN)


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(texts, size=4096):
    out = []
    for lo, hi, buf, off in textvec.chunks(pa.array(texts, pa.string()), size):
        bounds = textvec.pretokens(buf, off)
        cut = [p.decode() for p in textvec.binary_array(buf, bounds).to_pylist()]
        at = np.searchsorted(bounds[:-1], off)
        out += [cut[at[k] : at[k + 1]] for k in range(hi - lo)]
    return out


def test_pretokens_equal_the_pattern():
    rnd = random.Random(1)
    letters = [*"  \n\t'sstremvlld aéñ5²٣!?#_-   中😀'", "'re", "'ll", " 's"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(4000)] + [None, "", "'", "a's's"]
    assert pieces(texts) == [PATTERN.findall(t or "") for t in texts]


def test_words_and_shingles_do_not_depend_on_their_place():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["Aé", "b", "cc", "dd"], k=rnd.randint(0, 9))) for _ in range(200)] + [None, "", " "]
    seen = {}
    for size in (16, 1 << 20):
        for lo, hi, buf, off in textvec.chunks(pa.array(texts, pa.string()), size):
            w = textvec.words(buf, off)
            sh, bounds = textvec.shingles(textvec.span_hashes(buf, w.starts, w.ends), w.bounds)
            for k in range(hi - lo):
                own = (texts[lo + k] or "").lower().split()
                grams = [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []
                got = sh[bounds[k] : bounds[k + 1]].tolist()
                assert len(got) == len(grams)
                for g, h in zip(grams, got, strict=True):
                    assert seen.setdefault(g, h) == h
    assert len(set(seen.values())) == len(seen)


def test_round_trip_equals_the_library(odd_documents, reference_encoding):
    rows = bpe.round_trip(odd_documents, vocabulary("byte_bpe_50k.tiktoken"), block_bytes=1 << 16).collect()
    wanted = []
    for r in odd_documents.collect():
        ids = reference_encoding.encode_ordinary(r["text"] or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        wanted.append((r["doc_id"], len(ids), digest, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, wanted))


def test_encode_and_empty_table(odd_documents, reference_encoding):
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(odd_documents.where("doc_id is not null"), vocabulary("byte_bpe_50k.tiktoken")).collect()}
    assert ids[14] == reference_encoding.encode_ordinary("it's 5€ 中文 😀 <|endoftext|> 's") and ids[2] == []
    assert bpe.round_trip(odd_documents.limit(0), vocabulary("byte_bpe_50k.tiktoken")).count() == 0


def test_json_vocabulary_is_the_rank_vocabulary():
    ranks, special = bpe.ranks_of_json(vocabulary("byte_bpe_50k.json"))
    assert ranks == bpe.ranks_of(vocabulary("byte_bpe_50k.tiktoken")) and special == {"<|endoftext|>": 50256}


def test_packing(odd_documents):
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd_documents, vocabulary("byte_bpe_50k.json")).collect()
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
    for r in odd_documents.where("doc_id is not null and doc_id <> 11").collect():
        ids, at = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], 0
        for p in sorted(own[r["doc_id"]], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.TIERS[-1] and at & (at - 1) == 0
        assert {p["padded_length"] for p in parts} == {at}
    assert packing.pack_documents(odd_documents.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def packed(tiers, short=False):
    rnd = np.random.default_rng(1)
    packer = packing.Packer(tiers, 0, 8)
    for k in range(3000):
        n = 2 ** rnd.uniform(0, 10) if short else rnd.integers(1, 1500)
        packer.add(k, np.zeros(int(n), np.uint32))
    packer.flush(last=True)
    return packer.rows


def test_step_groups_are_balanced():
    cost, size = defaultdict(int), defaultdict(set)
    for r in packed(packing.TIERS):
        if r[7] == 1024:
            cost[r[9]] += r[2] ** 2
            size[r[9]].add(r[5])
    full = [cost[g] for g in cost if len(size[g]) == 8]
    assert len(full) > 20 and max(full) < 1.6 * min(full)


def test_tiers_are_packed_each_by_itself():
    rows, one = packed(packing.TIERS, True), packed((1024,), True)
    lengths = defaultdict(int)
    opened = {}
    for r in rows:
        lengths[r[5]] += r[2]
        opened[r[5]] = max(opened.get(r[5], 0), r[2])
    # sequences of every tier, full but for the tasks' last ones, and opened by a leftover of that tier
    sizes = list(lengths.values())
    assert all(sizes.count(t) > 5 for t in packing.TIERS)
    assert sum(s not in packing.TIERS for s in sizes) < 40
    assert [r[:2] for r in rows] != [r[:2] for r in one] and {sum(r[2] for r in x) for x in (rows, one)} == {sum(sizes)}
    tier_of = {r[5]: r[8] for r in rows}
    assert all(opened[s] > tier_of[s] // 2 for s in lengths if lengths[s] == tier_of[s] > 64)


def test_leftovers_go_to_the_smallest_tier():
    tiers = packing.Tiers((4, 8))
    piece = lambda n: packing.Piece(n, 0, np.zeros(n, np.uint32), n)
    for n in (3, 4, 5, 8):
        tiers.add(piece(n))
    assert [p.n for p in tiers.pools] == [2, 2]
    assert [[len(p.ids) for p in s] for s in packing.pack(tiers, last=True)] == [[8], [5, 3], [4]]
    with pytest.raises(ValueError):
        packing.pack_documents(None, b"", tiers=(8, 4))
