"""What Python workers hold while they encode and once they rest."""

import subprocess
import sys

import pyarrow as pa

from tablewright.llm import common

#: Prints MB of own memory with a new encoder, at most while random words are encoded, and at rest.
ENCODING = r"""
import random, re
import pyarrow as pa
import public_tokenizers
from tablewright.llm import common, tokens

def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = random.Random(5)
    for _ in range(5):
        yield pa.RecordBatch.from_pydict({"text": [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(250)) for _ in range(1000)]})

enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
new, most = held(), 0
for batch in common.by_size(batches(), tokens.ENCODE_BYTES):
    ids = enc.encode(common.texts_of(batch))
    most = max(most, held())
del batch, ids
enc._forget()
print(new, most, held())
"""


def test_an_encoder_at_rest_holds_little():
    out = subprocess.run([sys.executable, "-c", ENCODING], capture_output=True, text=True, check=True, timeout=300).stdout
    new, most, rest = map(float, out.split())
    assert rest - new < 0.25 * (most - new), out


def test_memory_is_given_back_now_and_then(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "trim", lambda: calls.append(1), raising=False)
    text = "x" * 1_000_000
    batches = [pa.RecordBatch.from_pydict({"text": [text] * 10 + [None]})] * 2
    assert sum(b.num_rows for b in common.by_size(iter(batches))) == 22
    assert len(calls) == 20 * 1_000_000 // common.TRIM_BYTES + 1
