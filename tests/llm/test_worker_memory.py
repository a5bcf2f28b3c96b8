"""What Python workers keep between tasks, in a process of its own."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

MEASURE = """
import re, sys
import pyarrow as pa
import public_tokenizers
from rolecall.llm import common, packing

def held():
    text = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", text))) / 1024

before = held()
ids_of = common.keep_in_worker("ids", lambda: packing.ChunkIds(public_tokenizers.path("word_bpe_49k.json")))
letters = "abcdefghijklmnopqrst"
words = lambda n: " ".join("".join(letters[k // 20 ** p % 20] for p in range(5)) for k in range(n, n + 20_000))
for n in range(0, 1_000_000, 20_000):
    ids_of.encode(pa.array([words(n)]))
full = held() - before
del ids_of
common.keep_in_worker("other", object)
print(full, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from /proc")
def test_chunk_ids_stay_small_and_go_with_the_next_stage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", MEASURE], cwd=root, capture_output=True, text=True, check=True)
    full, after = map(float, ran.stdout.split())
    assert full < 140 and after < 90, ran.stdout
