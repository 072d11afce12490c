"""BPE encoding and decoding with forced boundaries.

A merge can only make a vocabulary token. So where two neighbouring bytes occur next to each other inside no token,
no merge ever crosses, and the text can be cut there for certain. Words of the pre-tokenizer are cut at these places
into fragments; fragments are encoded independently and their ids concatenated, with the same result as encoding the
whole. Short fragments repeat, so each worker remembers them (a bounded memory).

The vocabulary is a byte-level BPE file in the JSON form of the `tokenizers` library; its path is a parameter and is
read on every executor. Texts are split between Spark's tasks; a worker holds one Arrow batch at a time.

A file with another kind of model, normalizer, pre-tokenizer or options than byte-level BPE is refused.

Edge cases: null text counts as empty: no ids, the digests of nothing. Special tokens' strings in a text get their
special ids, as in the library. Repeated rows are encoded each. An empty table gives an empty table. Input columns
with the names of output columns are replaced. Very long texts and fragments are encoded whole (a heap of merges, so
n log n). `decode` skips null and unknown ids, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_alone, quoted, without

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
REMEMBERED = 500_000
OUTPUTS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_sha256": T.StringType(), "decoded": T.StringType(), "decoded_sha256": T.StringType()}


def printable_bytes() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in same]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """A vocabulary file, read."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], printable_bytes()
        before = spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"{path} is no plain byte-level BPE")
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.bytes_of = {i: raw(s) for s, i in model["vocab"].items() if all(c in to_byte for c in s)}
        ids = {b: i for i, b in self.bytes_of.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(model["vocab"][a], model["vocab"][b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [model["vocab"][a + b] for a, b in pairs]
        self.first = [ids[bytes([b])] for b in range(256)]
        self.inside = bytearray(1 << 16)  # by pair of bytes: whether some token holds it
        for t in ids:
            for x, y in zip(t, t[1:], strict=False):
                self.inside[x << 8 | y] = 1
        special = spec.get("added_tokens") or []
        if any(t.get(k) for t in special for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain special tokens are supported")
        self.special = {t["content"]: t["id"] for t in special}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.parts: dict[bytes, tuple[int, ...]] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every forced boundary."""
        inside = self.inside
        cuts = [i for i, (x, y) in enumerate(zip(word, word[1:], strict=False), 1) if not inside[x << 8 | y]]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def merged(self, fragment: bytes) -> tuple[int, ...]:
        """Ids of one fragment: the merge of least rank first, leftmost among equals."""
        ids, made, rank, none = [self.first[b] for b in fragment], self.made, self.merges.get, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        if len(ids) <= 64:
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                ids[i] = made[least]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = rank((ids[i], ids[i + 1]), none)
            return tuple(ids)
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # a neighbour was merged meanwhile
            ids[i], ids[j], after[i] = made[least], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank((ids[a], ids[b]), none)) < none:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return tuple(i for i in ids if i is not None)

    def word(self, word: str) -> bytes:
        """A word's ids as little-endian 32-bit integers."""
        out: list[int] = []
        parts = self.fragments(word.encode("utf-8", "surrogatepass"))
        for part in parts:
            ids = self.parts.get(part)
            if ids is None:
                ids = self.merged(part)
                if len(parts) > 1 and len(part) <= 32:  # a whole word is remembered as such
                    if len(self.parts) >= REMEMBERED:
                        self.parts.clear()
                    self.parts[part] = ids
            out += ids
        packed = struct.pack(f"<{len(out)}I", *out)
        if len(word) <= 32:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        known, word = self.known, self.word
        ordinary = lambda t: b"".join([known.get(w) or word(w) for w in self.words.findall(t)])
        if self.split is None or not self.split.search(text):
            return ordinary(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [ordinary(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, ordinary(text[at:])])

    def decode(self, ids) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One per worker and path."""
    return keep_alone(("bpe", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """All columns of docs but the text, and the named OUTPUTS: ids, their number and digest, the text decoded from
    them and its digest."""
    keep = [c for c in without(docs, list(outputs)) if c != text]
    rows = docs.select(*[quoted(c) for c in keep], quoted(text))
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField(o, OUTPUTS[o]) for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        kinds = {"n_tokens": pa.int64()}
        for batch in batches:
            for first in range(0, len(batch), 256):  # ids are held as bytes, and for a few texts at a time
                part = batch.slice(first, 256)
                got: dict[str, list] = {o: [] for o in outputs}
                whole: list[bytes] = []
                for t in part.column(len(keep)):
                    packed = c.encode(t.as_py() or "")
                    whole.append(packed)
                    if "n_tokens" in got:
                        got["n_tokens"].append(len(packed) // 4)
                    if "ids_sha256" in got:
                        got["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    if "decoded" in got or "decoded_sha256" in got:
                        back = c.decode(memoryview(packed).cast("I") if packed else [])
                        if "decoded" in got:
                            got["decoded"].append(back)
                        if "decoded_sha256" in got:
                            got["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                columns = {o: pa.array(v, kinds.get(o, pa.string())) for o, v in got.items() if o != "ids"}
                if "ids" in got:
                    ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in whole]))).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(whole), "<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(columns[o] for o in outputs)], names=[*keep, *outputs])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of df, and the text of the ids (null: empty)."""

    @F.pandas_udf(T.StringType())
    def back(column):
        c = codec(path)
        known = c.bytes_of
        return column.map(lambda x: c.decode([] if x is None else [int(i) for i in x if i is not None and i in known]))

    return df.withColumn(into, back(quoted(ids)))
