"""Token ids in binary files, coded by a range asymmetric numeral system with static tables.

Documents are range-partitioned by doc_id and sorted; each partition is one shard, cut into sections of about
``SECTION`` tokens. A section is a self-contained file image (format below) and is written as a row of a
Parquet table in the shared folder, so that Spark's committer makes the files whole whatever executors are
lost. All blocks of a section share one frequency table and are coded independently, each with ``LANES``
interleaved states; the block index holds where each block starts, its states and its checksum, so blocks can be
decoded side by side or alone.

Section image, little-endian::

    b"SWR1"  u32 bits, lanes, steps, n_docs, n_tokens, n_symbols, n_blocks, end id
    u32 symbols[n_symbols]   u32 frequencies[n_symbols]      (sum 2**bits)
    i64 doc_ids[n_docs]      u8 doc_id_known[n_docs]     u32 doc_tokens[n_docs]
    blocks: u32 tokens, words, crc32 of the words and states   u64 states[lanes]
    u32 crc32 of all of the above
    u32 words of all blocks

Token t of a block belongs to lane t mod lanes. States are 64 bits wide and move 32-bit words.

Defined cases: null and empty texts hold only the end id; a null doc_id comes first; equal doc_ids are ordered by
text; an empty table gives no sections and an empty result; other columns are ignored. A broken section raises
ValueError. Memory for each task: one section of ids, and the bounded cache of words.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.llm.common import gathered, materialize, require, table

MAGIC = b"SWR1"
BITS = 18
LANES = 64
STEPS = 1024
SECTION = 2_000_000
END_ID = 1
#: Parts of words whose ids a worker keeps; beyond it they are forgotten.
CACHE = 1_000_000
#: Bytes of texts encoded at once.
GATHERED = 16 << 20
#: Parts given to the library in one call's text.
JOINED = 64
#: ASCII symbols that the split pattern keeps apart from letters before them (no apostrophe: it may begin a contraction).
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LOW = np.uint64(1 << 31)
U32 = np.uint64(32)


def stays_letters(s: str) -> bool:
    """Whether all are letters once the library has composed and lower-cased them; marks would end a piece inside."""
    return s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha())


class Words:
    """Ids of texts by the tokenizer's own library, which sees each part of a word that a worker meets once.

    Words are split and told apart by Arrow; letters and the symbols behind them are encoded apart, any other word goes as
    it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def ids_of(self, new: list[str], plain: bool) -> list[list[int]]:
        """One call for all; parts of letters are joined by spaces, of which each is one pre-token. plain: all are ASCII letters."""
        found: list = [None] * len(new)
        letters = range(len(new)) if plain else [i for i, x in enumerate(new) if stays_letters(x)]
        groups = [letters[i : i + JOINED] for i in range(0, len(letters), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join([new[i] for i in g]) for g in groups], add_special_tokens=False)):
            ids, at = e.ids, e.word_ids
            cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
            if len(cuts) == len(group) + 1:
                for i, lo, hi in zip(group, cuts, cuts[1:]):
                    found[i] = ids[lo:hi]
        others = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([new[i] for i in others], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def numbers(self, parts: list[str], plain: bool = False) -> np.ndarray:
        """Places of the parts in ``start`` and ``length``; unknown ones are learnt."""
        at = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        if (unknown := np.flatnonzero(at < 0)).size:
            new = list(dict.fromkeys([parts[i] for i in unknown.tolist()]))
            ids = self.ids_of(new, plain)
            n, lengths = len(self.number), np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(lengths.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(new) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            self.start[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.length[n : n + len(new)] = lengths
            self.used += total
            self.number.update(zip(new, range(n, n + len(new))))
            at[unknown] = [self.number[parts[i]] for i in unknown.tolist()]
        return at

    def split(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the head and the tail of each of an Arrow array's words; the empty part has place 0."""
        import pyarrow.compute as pc

        heads = pc.utf8_rtrim(words, characters=TAIL)
        plain = pc.ascii_is_alpha(heads).to_numpy(zero_copy_only=False)
        head, tail = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        own = np.flatnonzero(plain)
        low = pc.ascii_lower(heads.take(own)).dictionary_encode()
        head[own] = self.numbers(low.dictionary.to_numpy(zero_copy_only=False).tolist(), True)[low.indices.to_numpy()]
        size = pc.binary_length(heads).to_numpy()
        has = np.flatnonzero(plain & (pc.binary_length(words).to_numpy() > size))
        tail[has] = self.numbers([w[n:] for w, n in zip(words.take(has).to_numpy(zero_copy_only=False).tolist(), size[has].tolist())])
        rest = np.flatnonzero(~plain)
        if rest.size:
            whole = words.take(rest).to_pylist()
            cut = [len(h) if h and stays_letters(h) else len(w) for h, w in zip(heads.take(rest).to_pylist(), whole)]
            head[rest] = self.numbers([w[:n] for w, n in zip(whole, cut)])
            tail[rest] = self.numbers([w[n:] for w, n in zip(whole, cut)])
        return head, tail

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these places one after the other, and how many each has."""
        length = self.length[at]
        upto = np.cumsum(length)
        return self.flat[np.repeat(self.start[at] - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0)], length

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text, with the end id; texts: an Arrow array or a list."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.number) > CACHE:
            self.forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        words = pc.ascii_split_whitespace(texts)
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        coded = words.flatten().dictionary_encode()  # white space at an end makes an empty word, which has no ids
        flat, sizes = self.expand(np.stack(self.split(coded.dictionary), 1).ravel())
        length = sizes.reshape(-1, 2).sum(1)
        start = np.cumsum(length) - length
        at = coded.indices.to_numpy()
        each = length[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(start[at] - upto[:-1], each) + np.arange(upto[-1])]
        cuts = upto[ends]
        ids = np.insert(ids, cuts, END_ID)
        return np.split(ids, (cuts + np.arange(1, len(cuts) + 1))[:-1])


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur and their frequencies, scaled to sum 2**BITS, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    if len(symbols) > 1 << BITS:
        raise ValueError("more symbols than the table has slots")
    f = np.maximum(1, counts[symbols] * (1 << BITS) // len(ids)).astype(np.int64)
    over = int(f.sum()) - (1 << BITS)
    for i in np.argsort(-f, kind="stable"):
        if over == 0:
            break
        cut = min(over, int(f[i]) // 2) if over > 0 else over
        f[i] -= cut
        over -= cut
    while over > 0:  # only when nearly all slots are taken by single counts
        i = int(f.argmax())
        f[i] -= 1
        over -= 1
    return symbols.astype(np.uint32), f.astype(np.uint32)


def _encode_blocks(index: np.ndarray, f: np.ndarray, c: np.ndarray):
    """index: (blocks, steps, lanes) positions in the table. States and words of each block."""
    b, steps, lanes = index.shape
    x = np.full((b, lanes), LOW, np.uint64)
    emitted, masks = np.zeros((steps, b, lanes), np.uint32), np.zeros((steps, b, lanes), bool)
    room, bits = np.uint64(63 - BITS), np.uint64(BITS)
    for s in range(steps - 1, -1, -1):
        fs, cs = f[index[:, s]], c[index[:, s]]
        full = x >= (fs << room)
        masks[s] = full
        emitted[s] = x & np.uint64(0xFFFFFFFF)
        x = np.where(full, x >> U32, x)
        q = x // fs
        x = (q << bits) + (x - q * fs) + cs
    return x, [emitted[:, i][masks[:, i]] for i in range(b)]


def _decode_blocks(x: np.ndarray, starts: np.ndarray, stream: np.ndarray, steps: int, slots: np.ndarray, f: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty((x.shape[0], steps, x.shape[1]), np.int32)
    at, bits, low = starts.astype(np.int64), np.uint64(BITS), np.uint64((1 << BITS) - 1)
    stream = np.concatenate([stream, np.zeros(1, np.uint32)])
    for s in range(steps):
        slot = x & low
        i = slots[slot]
        out[:, s] = i
        x = f[i] * (x >> bits) + slot - c[i]
        short = x < LOW
        rank = np.cumsum(short, axis=1)
        word = stream[np.minimum(at[:, None] + rank - 1, len(stream) - 1)].astype(np.uint64)
        x = np.where(short, (x << U32) | word, x)
        at += rank[:, -1]
    return out


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """The section image of some documents' ids."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    n = len(ids)
    symbols, f32 = frequencies(ids) if n else (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    f = f32.astype(np.uint64)
    c = np.cumsum(f) - f
    where = np.zeros(int(symbols[-1]) + 1 if n else 1, np.int32)
    where[symbols] = np.arange(len(symbols))
    index = where[ids]
    block, whole = LANES * STEPS, n // (LANES * STEPS)
    parts = []
    if whole:
        parts.append(_encode_blocks(index[: whole * block].reshape(whole, STEPS, LANES), f, c))
    if rest := n - whole * block:
        steps = -(-rest // LANES)
        tail = np.full(steps * LANES, int(f.argmax()), np.int32)
        tail[:rest] = index[whole * block :]
        parts.append(_encode_blocks(tail.reshape(1, steps, LANES), f, c))
    states = [x for p in parts for x in p[0]]
    streams = [w for p in parts for w in p[1]]
    sizes = [block] * whole + [rest] * bool(rest)
    head = [MAGIC, struct.pack("<8I", BITS, LANES, STEPS, len(docs), n, len(symbols), len(sizes), END_ID), symbols.astype("<u4").tobytes(), f32.astype("<u4").tobytes()]
    head += [np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is not None for i in doc_ids], np.uint8).tobytes(), np.array([len(x) for x in docs], "<u4").tobytes()]
    for size, x, w in zip(sizes, states, streams):
        state = x.astype("<u8").tobytes()
        head.append(struct.pack("<3I", size, len(w), zlib.crc32(state, zlib.crc32(w.astype("<u4").tobytes()))) + state)
    top = b"".join(head)
    return top + struct.pack("<I", zlib.crc32(top)) + b"".join(w.astype("<u4").tobytes() for w in streams)


def unpack(image: bytes, only: range | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, tokens of each document, and all ids of a section; ``only``: the ids of these blocks."""
    view = memoryview(image)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a section")
    bits, lanes, steps, n_docs, n, n_symbols, n_blocks, _ = struct.unpack_from("<8I", image, 4)
    if bits != BITS:
        raise ValueError("another table size")
    at = 36

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    symbols, f = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.uint64)
    doc_ids, known, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    sizes, counts, sums, states = [], [], [], []
    for _ in range(n_blocks):
        size, count, crc = take("<u4", 3)
        sizes.append(int(size))
        counts.append(int(count))
        sums.append(int(crc))
        states.append(take("<u8", lanes))
    if zlib.crc32(view[:at]) != struct.unpack_from("<I", image, at)[0]:
        raise ValueError("the section's head is broken")
    at += 4
    stream = np.frombuffer(image, "<u4", sum(counts), at)
    starts = np.cumsum([0, *counts])
    for k in only or range(n_blocks):
        if zlib.crc32(states[k].tobytes(), zlib.crc32(stream[starts[k] : starts[k + 1]].tobytes())) != sums[k]:
            raise ValueError(f"block {k} is broken")
    c = np.cumsum(f) - f
    slots = np.repeat(np.arange(n_symbols, dtype=np.int32), f.astype(np.int64))
    out = []
    picked = list(only or range(n_blocks))
    for size in dict.fromkeys(sizes[k] for k in picked):  # whole blocks side by side, then the last
        own = [k for k in picked if sizes[k] == size]
        got = _decode_blocks(np.stack([states[k] for k in own]), starts[own], stream, -(-size // lanes), slots, f, c)
        out.append(symbols[got.reshape(len(own), -1)[:, :size].ravel()])
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    return [int(i) if k else None for i, k in zip(doc_ids, known)], lengths, ids


SECTIONS = "shard int, section int, n_docs long, n_tokens long, image binary"


class _Write:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        from pyspark import TaskContext

        shard, section = TaskContext.get().partitionId(), 0
        coder = words(self.path)
        ids, docs, held = [], [], 0
        for b in gathered(batches, GATHERED):
            for i, x in zip(b.column(0).to_pylist(), coder.encode(b.column(1))):
                ids.append(i)
                docs.append(x)
                held += len(x)
                if held >= SECTION:
                    yield self.row(shard, section, ids, docs, held)
                    ids, docs, held, section = [], [], 0, section + 1
        if docs:
            yield self.row(shard, section, ids, docs, held)

    @staticmethod
    def row(shard, section, ids, docs, held):
        import pyarrow as pa

        columns = [pa.array([shard], pa.int32()), pa.array([section], pa.int32()), pa.array([len(docs)]), pa.array([held]), pa.array([pack(ids, docs)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "section", "n_docs", "n_tokens", "image"])


def write(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' ids as sections in the shared folder; the table of sections, read from there."""
    require(docs, "doc_id", "text")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialize(rows.mapInArrow(_Write(path), SECTIONS), "token-sections")


def _read_batches(batches):
    import pyarrow as pa

    names = ["shard", "section", "doc_id", "inside", "n_tokens", "ids_crc32"]
    for b in batches:
        for shard, section, image in zip(*(c.to_pylist() for c in b.columns)):
            doc_ids, lengths, ids = unpack(image)
            data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths, dtype=np.int64)
            crc = [zlib.crc32(data[4 * int(e - n) : 4 * int(e)]) for e, n in zip(ends, lengths)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([section] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=names)


def read(sections: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the sections."""
    totals = sections.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = W.partitionBy("shard").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    starts = sections.select("shard", "section", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("section_start"))
    starts = starts.join(totals.select("shard", before.alias("shard_start")), "shard")
    rows = sections.select("shard", "section", "image").mapInArrow(_read_batches, "shard int, section int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "section"]).select("doc_id", (F.col("shard_start") + F.col("section_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op3_rans(spark, sf_dir):
    return read(write(table(spark, sf_dir, "documents")))
