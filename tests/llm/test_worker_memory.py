"""What a worker keeps of a task that read texts, while it idles beside its executor."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from lexigauge.llm import bpe, jaccard_join

SCRIPT = """
import re, sys
import numpy as np
import pyarrow as pa

def held():
    return sum(map(int, re.findall(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Frame:  # stands for a table: it has the function of batches that a query gives Spark
    def select(self, *columns): return self
    def mapInArrow(self, run, schema): return run

class Task:
    @staticmethod
    def get(): return Task()
    def partitionId(self): return 0

def batches():
    rnd = np.random.default_rng(5)
    for k in range(2):
        words = np.char.mod("%x", rnd.integers(0, 1 << 24, (4000, 600)))
        texts = [" ".join(row) for row in words]
        del words
        ids = pa.array(range(k * 4000, k * 4000 + 4000), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], names=["doc_id", "text", "key"])

if sys.argv[1] == "pack":
    import public_tokenizers
    from lexigauge.llm import packing as module
    vocabulary = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    module.encoder(vocabulary, "json")
    run = module.pack_documents(Frame(), vocabulary)
else:
    from lexigauge.llm import jaccard_join as module
    from lexigauge.llm import common
    run = getattr(common, "lean", lambda f: f)(module._cut(256, 5))
module.TaskContext = Task
before = held()
for batch in run(batches()):
    pass
del batch
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="the system doesn't tell a process's memory")
@pytest.mark.parametrize("what", ["pack", "cut"])
def test_an_idle_worker_holds_little(what):
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", SCRIPT, what], cwd=root, capture_output=True, text=True, timeout=300, check=True)
    assert float(done.stdout) < 80


def test_cached_pieces_are_as_small_as_their_ids():
    enc = bpe.encoder(b"\n".join(b"%s %d" % (bpe.base64.b64encode(bytes([k])), k) for k in range(256)), "ranks")[0]
    cache = bpe.PieceCache(enc)
    flat, sizes = cache.flat(bpe.pa.array([b"stone", "çok".encode(), b"stone"], bpe.pa.large_binary()))
    assert flat.tolist() == [*b"stone", *"çok".encode(), *b"stone"] and sizes.tolist() == [5, 4, 5]
    assert sum(map(sys.getsizeof, cache.known.values())) < 2 * 60
    none, sizes = cache.flat(bpe.pa.array([], bpe.pa.large_binary()))
    assert not len(none) and not len(sizes)


def test_dealing_out_a_block_takes_little_beside_it():
    block = jaccard_join.Block("0:0")
    rnd = np.random.default_rng(3)
    for k in range(200):
        block.add(k, np.unique(rnd.integers(0, 1 << 63, 1000).astype(np.uint64)), k)
    tracemalloc.start()
    rows = block.rows(256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.num_rows == 257 and peak < 155 * block.tokens
