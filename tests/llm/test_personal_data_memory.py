"""What a Python worker holds while it looks for personal data."""

import tracemalloc

import pyarrow as pa

from panelcast.llm import pii


def test_a_batch_is_not_held_as_python_objects():
    texts = [b"write to a@b.org or +49 30 1234567 " * 60, b"", "né \ud800".encode("utf-8", "surrogatepass")] * 1200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        n, emails, phones = 0, 0, 0
        for out in pii._digests(iter([batch])):
            n, emails, phones = n + out.num_rows, emails + sum(out.column(1).to_pylist()), phones + sum(out.column(4).to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (n, emails, phones) == (3600, 72_000, 72_000) and peak < sum(map(len, texts))
