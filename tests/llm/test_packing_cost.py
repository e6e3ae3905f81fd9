"""What splitting texts costs: no threads beside the task's own, and slices of even size."""

import subprocess
import sys

import pyarrow as pa

from papyra.llm import packing


def test_the_tokenizer_starts_no_threads():
    code = """if True:
        import os
        from papyra.llm.packing import Encoder
        enc, before = Encoder(None), len(os.listdir("/proc/self/task"))
        enc.encode(["#" + "x" * k + "#%d !? " % k * 20 for k in range(200)])
        print(len(os.listdir("/proc/self/task")) - before)"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split() == ["0"]


def test_slices_are_even_and_whole():
    sizes = [0, 5, *[packing.SLICE // 4] * 9, 0, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes])], ["k", "text"])
    parts = list(packing.slices(batch, 1))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(len(sizes)))
    assert len(parts) == 2 and min(p.nbytes for p in parts) > packing.SLICE // 2
    assert [len(p) for p in packing.slices(pa.RecordBatch.from_arrays([pa.array(["", None, ""])], ["text"]), 0)] == [3]
    assert not list(packing.slices(batch.slice(0, 0), 1))
