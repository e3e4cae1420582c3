"""What op3 and op8 hold at a time: memory of a Python worker, shuffle files on disk."""

import os
import random
import time
import tracemalloc

import numpy as np
import pytest

from tripweave.llm import rlz, sparse_suffix
from tripweave.llm.common import CLEANUP


def contexts(places: int, size: int, around: int):
    """Batches of a partition of blocks of four places, of which two have a word changed."""
    import pyarrow as pa

    rng = random.Random(1)
    names = ["key", "part", "split", "lo", "at", "hi", "row", "k", "words"]
    for first in range(0, places, 2000):
        words = []
        for _ in range(500):
            own = [b"%d" % rng.randrange(100_000) for _ in range(size + 2 * around)]
            other = [b"other", *own[1:]]
            words += [b" ".join(x) for x in (own, other, own, other)]
        row = np.arange(first, first + 2000)
        numbers = [pa.array(np.full(2000, x, np.int32)) for x in (0, around, size + 2 * around)]
        yield pa.RecordBatch.from_arrays([pa.array(row // 4), numbers[0], pa.array(np.zeros(2000, bool)), *numbers, pa.array(row), pa.array(row), pa.array(words, pa.binary())], names)


def test_a_worker_holds_little_however_large_its_partition():
    batches = list(contexts(40_000, sparse_suffix.head_words(50), sparse_suffix.WIDTH - 1))
    tracemalloc.start()
    found = sum(b.num_rows for b in sparse_suffix._matches(50)(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 40_000
    assert most < 160e6  # 196 MB with blocks of 32,768 places


def shuffled(spark):
    """Bytes of the shuffle files on disk, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in files if "/shuffle_" in f and os.path.exists(f)}


@pytest.mark.parametrize("made", [rlz.without_repeats, sparse_suffix.repeated_passages])
def test_no_step_leaves_its_shuffle_files(spark, made):
    rng = random.Random(3)
    passage = [str(rng.randrange(10**6)) for _ in range(400)]
    rows = [(i, " ".join([*passage, *(str(rng.randrange(10**6)) for _ in range(400))])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = shuffled(spark)
    before = spark.conf.get(CLEANUP)
    found = made(docs)  # all steps but the last are done here
    ends = time.time() + 20
    while (left := sum(n for f, n in shuffled(spark).items() if f not in old)) > 20_000 and time.time() < ends:
        time.sleep(0.2)
    assert left <= 20_000  # 80,000 and more otherwise
    assert spark.conf.get(CLEANUP) == before
    assert found.count() == 40 and len(found.collect()) == 40
