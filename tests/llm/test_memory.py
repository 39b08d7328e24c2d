"""What Python workers keep between tasks."""

import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from sagebrook.llm.common import giving_back


def anonymous_mb() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{os.getpid()}/status").read_text())[1]) / 1024


def test_a_finished_task_gives_its_memory_back():
    def work(batches):
        held = [np.ones(1 << 12) for _ in range(6400)]  # 200 MB in pieces that the allocator keeps below the last one
        keep.append(np.ones(1 << 10))
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], ["n"])

    keep: list[np.ndarray] = []
    before = anonymous_mb()
    list(giving_back(work)(iter([])))
    assert anonymous_mb() - before < 100
