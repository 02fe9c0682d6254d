"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece's symbols there is exactly one token with which the prefix's encoding ends. An
automaton of all vocabulary entries (suffix links) lists the tokens that end at a position, longest first; a
token is the one sought if the pair of it and the last token of the prefix before it is compatible: undoing
merges on both sides, from the latest, never meets a pair that would have merged earlier. The exact ids are
read off by following the last tokens backwards. New pieces of a batch are encoded in sorted order, so the
states of a prefix that two pieces share are computed once.

The tokenizer file is read as its library reads it: added tokens first, NFC, white space, lower case, the
split pattern, bytes as characters, an end-of-word suffix on the last symbol; decoding joins token strings as
a file without decoder asks. Texts are cut at ASCII white space, across which none of these steps looks.

Defined cases: null and empty texts have no tokens and decode to an empty text; very long texts and words
take linear time; null doc_ids and repeated rows are kept; an empty table gives an empty result; other columns
are ignored by ``digests`` and kept by ``encode``. Caches are bounded by ``CACHE`` entries for each worker, and go
when another operator begins in it.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from functools import lru_cache
from unicodedata import category

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftwell.llm.common import gathered, hold, require, table, trim, words_of

#: Entries of a worker's caches of pieces; beyond it they are emptied.
CACHE = 300_000
#: Longer pieces are encoded but not kept.
LONGEST_KEPT = 64
#: Bytes of texts whose words are learnt at once; a batch's words and ids take up to 25 times that.
GATHERED = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else extra))
        extra += b not in plain
    return letters


class Model:
    """Vocabulary, merges and automaton of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback"), "a plain BPE file"
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        letters = byte_letters()
        # symbols 0..255 are bytes, 256..511 bytes that end a word
        base = [self.vocab[c] for c in letters] + [self.vocab[c + self.suffix] for c in letters]
        value = self.value = {c: b for b, c in enumerate(letters)}
        self.path, self._library = path, None
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {i: -1 for i in base}
        for r, (a, b) in enumerate(model["merges"]):
            a, b = self.vocab[a], self.vocab[b]
            c = self.vocab[self.tokens[a] + self.tokens[b]]
            if (a, b) not in self.pairs:
                self.pairs[a, b] = r
            if c not in self.parts and self.rank.get(c) != -1:
                self.parts[c], self.rank[c] = (a, b), r
        self._automaton(base, value)
        self._fits: dict[tuple[int, int], bool] = {}

    def _automaton(self, base: list[int], value: dict[str, int]) -> None:
        """Trie over symbols with failure links; ends[state]: (token, symbols) that end there, longest first."""
        self.step: list[dict[int, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for t, i in self.vocab.items():
            if i not in self.rank:
                continue
            body = t[: -len(self.suffix)] if i in self._enders(base) or (self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix)) else t
            symbols = [value[c] for c in body]
            if body is not t and len(body) < len(t):
                symbols[-1] += 256
            at = 0
            for s in symbols:
                if s not in self.step[at]:
                    self.step[at][s] = len(self.step)
                    self.step.append({})
                    own.append(None)
                at = self.step[at][s]
            own[at] = (i, len(symbols))
        self.fail = [0] * len(self.step)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        queue = list(self.step[0].values())
        for s in queue:
            self.ends[s] = (own[s],) if own[s] else ()
        for state in queue:
            for s, to in self.step[state].items():
                f = self.fail[state]
                while f and s not in self.step[f]:
                    f = self.fail[f]
                self.fail[to] = self.step[f].get(s, 0)
                self.ends[to] = ((own[to],) if own[to] else ()) + self.ends[self.fail[to]]
                queue.append(to)

    def _enders(self, base: list[int]) -> frozenset[int]:
        if not hasattr(self, "_ender_ids"):
            self._ender_ids = frozenset(base[256:])
        return self._ender_ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's symbols together is a, b."""
        key = (a, b)
        known = self._fits.get(key)
        if known is not None:
            return known
        if len(self._fits) >= CACHE:
            self._fits.clear()
        rank, limit, out = self.rank, 1 << 60, True
        while True:
            r = self.pairs.get((a, b))
            if r is not None and r < limit:
                out = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        self._fits[key] = out
        return out

    def encode_sorted(self, pieces: list[bytes]):
        """(piece, ids) for each of the sorted non-empty pieces."""
        step, fail, ends, compatible = self.step, self.fail, self.ends, self.compatible
        before = b""
        states, last, back = [0], [-1], [0]  # after each prefix: automaton state, last token, its symbols
        for piece in pieces:
            n, shared = len(piece), 0
            most = min(n - 1, len(before) - 1)
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            before = piece
            for i in range(shared, n):
                s = piece[i] if i < n - 1 or not self.suffix else piece[i] + 256
                at = states[i]
                while at and s not in step[at]:
                    at = fail[at]
                at = step[at].get(s, 0)
                states.append(at)
                for t, m in ends[at]:
                    j = i + 1 - m
                    if j == 0 or compatible(last[j], t):
                        last.append(t)
                        back.append(m)
                        break
                else:
                    raise ValueError(f"no token ends {piece[: i + 1]!r}")
            ids, i = [], n
            while i:
                ids.append(last[i])
                i -= back[i]
            ids.reverse()
            yield piece, tuple(ids)

    def pieces(self, word: str) -> list[bytes | int]:
        """The split parts of a word as bytes, and ids of added tokens, in order."""
        out: list[bytes | int] = []
        at = 0
        if self.split_added and "<" in word:
            for m in self.split_added.finditer(word):
                out += self._split(word[at : m.start()])
                out.append(self.added[m[0]])
                at = m.end()
        return out + self._split(word[at:] if at else word)

    def _split(self, s: str) -> list[bytes]:
        if s.isascii():
            s = s.lower()
            return [s.encode()] if s.isalpha() else [x.encode() for x in self.pattern.findall(s)]
        if not s.isalpha() and any(category(ch) == "Cn" for ch in s):
            return self._split_by_library(s)
        s = unicodedata.normalize("NFC", s)
        s = "".join(map(str.lower, s)) if "Σ" in s else s.lower()
        if s.isalpha():
            return [s.encode()]
        return [x.encode("utf-8", "surrogatepass") for x in self.pattern.findall(s)]


    def _split_by_library(self, s: str) -> list[bytes]:
        """The pieces of a word with characters that the installed Python doesn't know, by the library's own tables."""
        if self._library is None:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.path)
            self._library = (t.normalizer, t.pre_tokenizer)
        normal, split = self._library
        return [bytes(self.value[c] for c in piece) for piece, _ in split.pre_tokenize_str(normal.normalize_str(s))]


class Coder:
    """Encodes and decodes texts; keeps the encodings of words seen lately."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.long: list = []

    def learn(self, texts_words: list[list[str]]) -> None:
        """Encode the words of a batch that are not known yet; pieces are kept apart, as words share them."""
        for known in (self.words, self.pieces):
            if len(known) > CACHE:
                known.clear()
        words, pieces = self.words, self.pieces
        new = [w for w in set().union(*texts_words) if w not in words]
        split = list(map(self.model.pieces, new))
        todo = sorted({p for ps in split for p in ps if type(p) is bytes and p not in pieces})
        pieces.update(self.model.encode_sorted(todo))
        for w, ps in zip(new, split):
            words[w] = pieces[ps[0]] if len(ps) == 1 and type(ps[0]) is bytes else tuple(i for p in ps for i in (pieces[p] if type(p) is bytes else (p,)))
        self.long = [w for w in new if len(w) > LONGEST_KEPT], [p for p in todo if len(p) > LONGEST_KEPT]

    def forget_long(self) -> None:
        for known, long in zip((self.words, self.pieces), self.long):
            for x in long:
                del known[x]
        self.long = []

    def encode(self, text: str | None) -> list[int]:
        words = words_of(text)
        self.learn([words])
        return [i for w in words for i in self.words[w]]

    def decode(self, ids) -> str:
        tokens = self.model.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Batches:
    """Adds ``ids`` to each row of the batches."""

    def __init__(self, path: str, digest: bool):
        self.path, self.digest = path, digest

    def __call__(self, batches):
        hold("bpe", coder.cache_clear)
        gc.disable()  # what is made here holds no cycles, and the caches are large to search for them
        try:
            yield from self.coded(batches)
        finally:
            gc.enable()
            trim()

    def coded(self, batches):
        import pyarrow as pa

        c = coder(self.path)
        for b in gathered(batches, GATHERED):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            words = [words_of(x) for x in texts]
            c.learn(words or [[]])
            if self.digest:
                rows = [self.digests(c, ws) for ws in words]
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                ids = [[i for w in ws for i in c.words[w]] for ws in words]
                row = pa.StructArray.from_arrays(b.columns, fields=list(b.schema))
                yield pa.RecordBatch.from_arrays([row, pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])
            c.forget_long()
            trim()

    @staticmethod
    def digests(c: Coder, words: list[str]) -> tuple[int, str, str]:
        ids = [i for w in words for i in c.words[w]]
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each document as ``row`` (a struct of its columns) and ``ids``."""
    require(docs, "text")
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    return docs.mapInArrow(_Batches(path or default_path(), False), T.StructType([T.StructField("row", docs.schema), ids]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ids stand for."""
    require(encoded, "row", "ids")
    return encoded.mapInArrow(_Decode(path or default_path()), T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())]))


class _Decode:
    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches):
        import pyarrow as pa

        c = coder(self.path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode(x or ()) for x in ids], pa.string())], names=[*b.schema.names, "decoded"])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in the same pass."""
    require(docs, "doc_id", "text")
    return docs.select("doc_id", "text").mapInArrow(_Batches(path or default_path(), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
