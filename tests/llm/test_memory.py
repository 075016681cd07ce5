"""What Python workers hold between tasks."""

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import gc, re
import pyarrow as pa
from lodestar.llm.common import sliced

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for k in range(6):
        yield pa.record_batch([pa.array([f"{i} " * 150 for i in range(20_000)])], names=["text"])

def task():
    kept = []
    for k, batch in enumerate(sliced(batches())):
        texts = batch.column(0).to_pylist()
        kept.append(texts[k % len(texts)])  # little stays, spread over what was used
    return kept

before = held()
kept = task()
print(held() - before)
"""


def test_a_worker_gives_back_the_memory_of_a_task():
    repo = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", PROGRAM], cwd=repo, capture_output=True, text=True, check=True, timeout=120).stdout
    assert float(out) < 64  # MB; 122 where nothing is given back
