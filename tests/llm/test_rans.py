import struct
import zlib

import numpy as np
import pytest

from siftwell.llm import rans


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 70_000, 200_001])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    docs = np.split(ids, np.sort(rng.integers(0, n + 1, 5)))
    image = rans.pack([3, None, 5, 6, 7, 8], docs)
    doc_ids, lengths, back = rans.unpack(image)
    assert doc_ids == [3, None, 5, 6, 7, 8] and lengths.tolist() == list(map(len, docs)) and (back == ids).all()
    if n > 2 * rans.LANES * rans.STEPS:
        block = rans.LANES * rans.STEPS
        assert (rans.unpack(image, range(1, 2))[2] == ids[block : 2 * block]).all()


def test_one_symbol_and_damage():
    image = rans.pack([1], [np.full(1000, 7, np.uint32)])
    assert (rans.unpack(image)[2] == 7).all()
    for at in (50, len(image) - 1):
        bad = bytearray(rans.pack([1], [np.arange(3000, dtype=np.uint32)]))
        bad[at if at < 60 else len(bad) - 1] ^= 1
        with pytest.raises(ValueError):
            rans.unpack(bytes(bad))


def test_frame(docs, none, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = rans.read(rans.write(docs, path)).collect()
    source = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(rows) == len(source)
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r, d in zip(rows, source):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert rans.read(rans.write(none, path)).count() == 0
