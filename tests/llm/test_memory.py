"""Workers live on between the stages of a pipeline: what a stage has freed goes back to the system."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FREED = """
import os
import re
from siftwell.llm import common

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

common.hold("first", lambda: cache.clear())
base = held()
# blocks below the size at which the C library maps them apart, and one small block after each, which pins the heap's end
cache = {i: bytearray(100_000) for i in range(1500)}
kept = [cache.pop(i) for i in range(0, 1500, 50)]
full = held()
common.hold("second")
print(full - base, held() - base)
"""


def test_a_stage_that_begins_gets_the_memory_of_the_one_before():
    out = subprocess.run([sys.executable, "-c", FREED], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    full, left = map(float, re.findall(r"[-\d.]+", out))
    assert full > 100 and left < 20
