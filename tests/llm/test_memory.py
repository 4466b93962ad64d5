"""What a worker holds at once."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import language, near
from quarry.session import SCALE_CONF


@pytest.fixture(scope="module")
def batches(sentences):
    """8 MB of texts in batches as large as the session's."""
    rng = random.Random(3)
    text = sentences(rng, 4000)[:8192]
    size = int(SCALE_CONF["spark.sql.execution.arrow.maxBytesPerBatch"])
    texts = [f"{i} {text}" for i in range((8 << 20) // len(text))]
    step = max(1, size // len(text))
    return [pa.record_batch({"id": pa.array(range(lo, min(lo + step, len(texts)))), "text": texts[lo:lo + step],
                             "lang": ["en"] * len(texts[lo:lo + step])}) for lo in range(0, len(texts), step)]


def peak(fn) -> float:
    """MB of numpy arrays that stand at once."""
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_worker_signs_and_counts_in_small_blocks(batches):
    rows = [b.select(["text", "lang"]) for b in batches]
    signed = peak(lambda: [len(b) for b in near._signed("text")(iter(batches))])
    counted = peak(lambda: [len(b) for b in language._counted("text", 4)(iter(rows))])
    assert signed < 135 and counted < 110


def test_batches_and_freed_buffers_are_small():
    assert int(SCALE_CONF["spark.sql.execution.arrow.maxBytesPerBatch"]) <= 4 << 20
    assert pa.default_memory_pool().backend_name == "system"
    before = pa.total_allocated_bytes()
    x = pa.array(np.zeros(1 << 20))
    del x
    assert pa.total_allocated_bytes() == before
