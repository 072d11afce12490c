"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct n-word shingles. Two documents link when
scale * |A and B| >= least * |A or B|. Stages:

1. Equal sets are one class, a node of its own number; its representative is the smallest document id (copies are
   never paired).
2. Routing, exact: which sets may meet at all. Sizes are in classes of ratio 3/2. A pair that links has at most d
   differing shingles, d by the largest sizes of the class. The hash space is split into more than d parts, so some
   part is the same in both sets: a class's digests of non-empty parts are its keys. (Parts that are empty in both
   don't tell; there are `slack` more parts than needed, and only pairs in which both sets have more empty parts than
   that can have no filled part in common: such sets, small ones, also have keys from their least hashes, by the
   prefix filter.) Connected components of "shares a key" are blocks: every linking pair lies in one block. Batches
   and partitions pass on spanning forests only.
3. Signature trees. A block's sets are dealt into leaf tables bounded in sets and in shingles. A leaf's tree has nodes
   with the OR of their children's bitmaps and the range of their sizes, FAN children each; the leaves of a block hang
   under further nodes of the same kind, as tables by level. A dual traversal goes down from pairs of roots, and drops
   node pairs whose greatest possible overlap can't link, and pairs within one component; what is left of set pairs is
   verified on the sets.
4. Order of traversal: each leaf with itself and with one leaf of its block, which joins most of what links. Sets are
   then dealt again by the components found, and the trees of the block are traversed level by level; node pairs of
   one component fall at the top, pruned leaf pairs ship no sets. Links are spanning links: a pair that is connected
   already is skipped, so their number stays near that of the sets.
5. Components of the links, and membership of copies.

Nodes are texts' sets, not ids: rows that repeat an id with another text have that text's links. component_id is the
smallest id of any row reachable by links. Edge cases: null or wordless text has an empty set, is linked with nothing
and is its own component; fewer than n words: the whole sequence is one shingle; rows with a null id are kept with a
null component and link nothing; an empty table gives an empty table. Only the id and text are read: extra columns
don't clash. Two texts of one id whose 64-bit hashes agree would count as one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, forget, mix64, quoted, shingle_hashes, word_hashes
from .graph import components

#: Bits of a node's bitmap; sets and shingles of a leaf on average; children of a node.
BITS = 4096
LEAF, LEAF_SHINGLES, FAN = 2048, 1 << 20, 8
#: Texts that Python gets at once, and keys that are put in order together.
TEXTS, TOGETHER = 2000, 200_000
#: Leading bits of a key that go on (keys that agree in them only meet needlessly); leaves that Python gets at once.
KEY_BITS, LEAVES = 48, 64
#: A component of so many sets of a block has leaves of its own; leaves under a node of the table.
OWN, TRUNK = 64, 32


def shingle_set(text: str | None, n: int) -> np.ndarray:
    words, _, _, _ = word_hashes(text)
    return np.unique(shingle_hashes(words, n))


# -- blocking ---------------------------------------------------------------------------------


@lru_cache(None)
def size_class(c: int, least: int, scale: int) -> tuple[int, int, int, int]:
    """Of class c: smallest size, first size beyond, number of parts, slack."""
    low = 1
    for _ in range(c):
        low = max(low + 1, low * 3 // 2)
    high = max(low + 1, low * 3 // 2)
    # the partner of a set of this class has at most (high - 1) * scale / least shingles
    other = (high - 1) * scale // least
    d = (high - 1 + other) * (scale - least) // (scale + least)
    slack = 0
    for _ in range(50):
        parts = d + 1 + slack
        empty = parts * math.exp(-low / parts)
        want = math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.02 else 0
        if want <= slack:
            break
        slack = want
        if slack > (d + 1) / 3:  # small sets: the prefix filter does for them
            slack = 0
            break
    return low, high, d + 1 + slack, slack


def class_of(n: int, least: int, scale: int) -> int:
    c = 0
    while size_class(c, least, scale)[1] <= n:
        c += 1
    return c


def block_keys(s: np.ndarray, least: int, scale: int) -> np.ndarray:
    """Keys of which two linking sets that differ have one in common."""
    n = len(s)
    if not n:
        return s
    c = class_of(n, least, scale)
    classes = [c]
    if c and n * least <= (size_class(c, least, scale)[0] - 1) * scale:  # may link into the class below
        classes.append(c - 1)
        if c > 1 and n * least <= (size_class(c - 1, least, scale)[0] - 1) * scale:
            classes.append(c - 2)
    out = []
    scrambled = mix64(s + np.uint64(0x51ED270B))
    for k in classes:
        _, _, parts, slack = size_class(k, least, scale)
        part = (scrambled >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part, values = part[order], scrambled[order]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(mix64(values + np.uint64(0x9E37)), first)
        seed = np.uint64(k * 2 + 1)
        out.append(mix64(mix64(sums + seed) ^ part[first] * np.uint64(0xA0761D6478BD642F)))
        if parts - len(first) > slack:
            # the least hashes, one more than two linking sets can differ by on one side
            prefix = np.sort(scrambled)[: n - -(-least * n // scale) + 1]
            out.append(mix64(prefix ^ mix64(np.array([k + 1000003], np.uint64))))
    return np.unique(np.concatenate(out))


def linked(a: int, b: int, both: int, least: int, scale: int) -> bool:
    return scale * both >= least * (a + b - both)


# -- signature trees --------------------------------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1).astype(np.int64)


class Level:
    """Nodes of one height: bitmaps, ranges of sizes, most shingles that share a bit with another of their set, and
    the component of all sets below (-1 if there are several)."""

    def __init__(self, bits: np.ndarray, least: np.ndarray, most: np.ndarray, more: np.ndarray, label: np.ndarray):
        self.bits, self.least, self.most, self.more, self.label = bits, least, most, more, label

    def __len__(self) -> int:
        return len(self.least)

    def above(self) -> Level:
        """The nodes over runs of FAN nodes."""
        first = np.arange(0, len(self), FAN)
        low, high = np.minimum.reduceat(self.label, first), np.maximum.reduceat(self.label, first)
        return Level(np.bitwise_or.reduceat(self.bits, first, axis=0), np.minimum.reduceat(self.least, first), np.maximum.reduceat(self.most, first), np.maximum.reduceat(self.more, first), np.where(low == high, low, -1))


def may_link(x: Level, i: np.ndarray, y: Level, j: np.ndarray, least: int, scale: int) -> np.ndarray:
    """Which node pairs can hold a link between components: by component, sizes and greatest possible overlap (common
    bits and what may share a bit)."""
    ok = (x.label[i] != y.label[j]) | (x.label[i] < 0)
    ok &= (least * x.least[i] <= scale * y.most[j]) & (least * y.least[j] <= scale * x.most[i])
    at = np.flatnonzero(ok)
    for first in range(0, len(at), 8192):
        k = at[first : first + 8192]
        bound = popcount(x.bits[i[k]] & y.bits[j[k]]) + np.minimum(x.more[i[k]], y.more[j[k]])
        ok[k] = (scale + least) * bound >= least * (x.least[i[k]] + y.least[j[k]])
    return ok


class Tree:
    """A leaf table's sets under nodes up to one root."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], labels: list[int] | None = None):
        labels = ids if labels is None else labels
        order = sorted(range(len(ids)), key=lambda i: (labels[i] if labels is not ids else 0, len(sets[i]), ids[i]))
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.labels = np.array([labels[i] for i in order], np.int64)
        sizes = np.array([len(s) for s in self.sets], np.int64)
        bits = np.zeros((len(ids), BITS), bool)
        for i, s in enumerate(self.sets):
            bits[i, (s % np.uint64(BITS)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        self.levels = [Level(packed, sizes, sizes, sizes - popcount(packed), self.labels)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].above())


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def descend(x: Tree, y: Tree, least: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Set pairs (each once where x is y) that are left of a dual traversal from the roots."""
    high, low = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok = may_link(x.levels[high], i, y.levels[low], j, least, scale)
        i, j = i[ok], j[ok]
        if not high and not low:
            return (i[i < j], j[i < j]) if x is y else (i, j)
        step = np.arange(FAN)
        if high >= low:  # the taller side goes down; of one tree both do
            i, j = (i[:, None] * FAN + step).ravel(), np.repeat(j, FAN)
            high -= 1
            ok = i < len(x.levels[high])
            i, j = i[ok], j[ok]
        if low > high or (x is y):
            i, j = np.repeat(i, FAN), (j[:, None] * FAN + step).ravel()
            low -= 1
            ok = j < len(y.levels[low])
            i, j = i[ok], j[ok]
        if x is y:
            i, j = i[i <= j], j[i <= j]


def traverse(x: Tree, y: Tree, least: int, scale: int, seen: Union) -> Iterator[tuple[int, int]]:
    """Links between the sets of two trees (or of one with itself) that join what isn't connected yet."""
    i, j = descend(x, y, least, scale)
    while len(i):
        left = np.array([seen.find(v) for v in x.labels.tolist()])
        right = left if x is y else np.array([seen.find(v) for v in y.labels.tolist()])
        apart = left[i] != right[j]
        i, j = i[apart], j[apart]
        p, q = i[:512], j[:512]
        i, j = i[512:], j[512:]
        if not len(p):
            return
        rows, p = np.unique(p, return_inverse=True)
        columns, q = np.unique(q, return_inverse=True)
        shared = overlaps([x.sets[k] for k in rows], [y.sets[k] for k in columns], p, q)
        for a, b, both in zip(rows[p].tolist(), columns[q].tolist(), shared.tolist(), strict=True):
            if linked(len(x.sets[a]), len(y.sets[b]), both, least, scale) and seen.find(int(x.labels[a])) != seen.find(int(y.labels[b])):
                seen.join(int(x.labels[a]), int(y.labels[b]))
                yield x.ids[a], y.ids[b]


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of xs[p] and ys[q] by marks over the shingles of the first."""
    if len(p) < 4 * (len(xs) + len(ys)) // 3:
        return np.array([len(np.intersect1d(xs[a], ys[b], assume_unique=True)) for a, b in zip(p.tolist(), q.tolist(), strict=True)])
    known, where = np.unique(np.concatenate(xs), return_inverse=True)
    out = np.zeros((len(xs), len(ys)), np.int64)
    right = []
    for s in ys:
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        right.append(at[known[at] == s])
    ends = np.cumsum([len(s) for s in xs])
    mark = np.zeros(len(known), bool)
    for k, s in enumerate(xs):
        mine = where[ends[k] - len(s) : ends[k]]
        mark[mine] = True
        for b in np.unique(q[p == k]).tolist():
            out[k, b] = np.count_nonzero(mark[right[b]])
        mark[mine] = False
    return out[p, q]


# -- the join ---------------------------------------------------------------------------------

SETS = "doc_id long, h long, n_shingles long, digest binary, short long"
KEYED = "k long, a long, b long"
LINKS = "a long, b long"
NODE = "size long, least long, most long, more long, label long, bits binary"


def batch_of(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))


def forest(pairs: np.ndarray) -> np.ndarray:
    """Rows (a, b) that span the same components."""
    seen, keep = Union(), np.zeros(len(pairs), bool)
    for k, (a, b) in enumerate(pairs.tolist()):
        if seen.find(a) != seen.find(b):
            seen.join(a, b)
            keep[k] = True
    return pairs[keep]


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def short(digest: bytes) -> int:
    """The first half of a digest, for routing: two sets that share it only meet needlessly."""
    return int.from_bytes(digest[:8], "little", signed=True)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, h, n_shingles, digest of the set, its first half) by row of (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part = batch.slice(first, 1000)
                sets = [shingle_set(t.as_py(), n) for t in part.column(2)]
                digests = [digest_of(s) for s in sets]
                yield batch_of({"doc_id": part.column(0), "h": part.column(1), "n_shingles": [len(s) for s in sets], "digest": pa.array(digests, pa.binary()), "short": [short(d) for d in digests]})

    return docs.mapInArrow(run, SETS)


def stars(texts: DataFrame, n: int, least: int, scale: int) -> DataFrame:
    """(a, b), short digests, that span the components of "shares a key", of a column of texts. Pairs are made
    within a part of a batch (TOGETHER keys) where they can be, and equal sets of a part count once; only its smallest
    set of a key goes on (b is null), so the second step has a few rows for the largest group."""

    def starred(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        ids = np.repeat(np.array(list(sets), np.int64), [len(k) for k in sets.values()])
        keys = np.concatenate([*sets.values(), np.empty(0, np.int64)])
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(keys) else ids
        found = np.unique(np.stack((head[~new], ids[~new]), axis=1), axis=0)
        found = forest(found[found[:, 0] != found[:, 1]])
        # a pair goes on under a key of its own; it passes through the next step
        a, b = np.concatenate((ids[new], found[:, 0])), np.concatenate((ids[new], found[:, 1]))
        k = np.concatenate((keys[new], (mix64(found[:, 1].astype(np.uint64)) >> np.uint64(64 - KEY_BITS)).view(np.int64)))
        order = np.argsort(a, kind="stable")  # equal ids next to each other pack well
        k, a, b = k[order], a[order], b[order]
        return batch_of({"k": k, "a": a, "b": pa.array(b, mask=a == b)})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            held = 0
            for t in batch.column(0):
                s = shingle_set(t.as_py(), n)
                if len(s) and (i := short(digest_of(s))) not in sets:
                    sets[i] = np.unique(block_keys(s, least, scale) >> np.uint64(64 - KEY_BITS)).view(np.int64)
                    held += len(sets[i])
                if held >= TOGETHER:
                    yield starred(sets)
                    sets, held = {}, 0
            yield starred(sets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, head = None, None  # of the group that runs on into the next batch
        for batch in batches:
            k, a = (batch.column(i).to_numpy() for i in range(2))
            if not len(k):
                continue
            through = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            b = batch.column(2).fill_null(0).to_numpy()
            out = [np.stack((a[through], b[through]), axis=1)]
            k, a = k[~through], a[~through]
            if len(k):
                new = np.concatenate(([k[0] != key], k[1:] != k[:-1]))
                at = np.cumsum(new) - 1
                heads = a[np.flatnonzero(new)]
                mine = np.where(at >= 0, heads[np.maximum(at, 0)] if len(heads) else head, head if head is not None else 0)
                out.append(np.stack((mine, a), axis=1)[mine != a])
                key, head = k[-1], mine[-1]
            pairs = forest(np.unique(np.concatenate(out), axis=0))
            yield batch_of({"a": pairs[:, 0].astype(np.int64), "b": pairs[:, 1].astype(np.int64)})

    rows = texts.mapInArrow(combine, KEYED)
    return rows.repartition("k").sortWithinPartitions("k", "a").mapInArrow(scan, LINKS).distinct()


def planted(items, nodes: str = "node", labels: str | None = None) -> Tree:
    """The tree of a leaf's rows."""
    return Tree([x[nodes] for x in items], [np.frombuffer(x["shingles"], np.uint64) for x in items], [x[labels] for x in items] if labels else None)


def found(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch_of({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]})


def first_links(leaves: DataFrame, least: int, scale: int) -> DataFrame:
    """Links within leaves, and between a block's leaves and its leaf 0."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for sets in batch.column(0):
                t = planted(sets.as_py())
                yield found(list(traverse(t, t, least, scale, Union())))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield found(list(traverse(planted(x.as_py()), planted(y.as_py()), least, scale, Union())))

    # leaf 0 goes to groups of TRUNK leaves, so a block of very many leaves spreads over tasks
    run = F.floor(F.col("leaf") / TRUNK)
    hub = leaves.filter("leaf = 0 and leaves > 1").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("leaves") - 1) / TRUNK))).alias("run"), "sets")
    other = leaves.filter("leaf > 0").select("block", run.alias("run"), F.col("sets").alias("sets2"))
    return leaves.select("sets").mapInArrow(within, LINKS).union(hub.join(other, ["block", "run"]).select("sets", "sets2").mapInArrow(across, LINKS))


def summed(groups: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Nodes over `children`, an array of nodes, by row; beside the key columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                out = []
                for children in part.column(len(keys)):
                    c = children.as_py()
                    bits = np.bitwise_or.reduce([np.frombuffer(x["bits"], np.uint64) for x in c], axis=0)
                    labels = {x["label"] for x in c}
                    out.append((sum(x["size"] for x in c), min(x["least"] for x in c), max(x["most"] for x in c), max(x["more"] for x in c), labels.pop() if len(labels) == 1 else -1, bits.tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield batch_of({**dict(zip(keys, part.columns, strict=False)), **dict(zip(("size", "least", "most", "more", "label"), columns, strict=False)), "bits": pa.array(columns[5], pa.binary())})

    return groups.mapInArrow(run, schema)


NODES = ("least", "most", "more", "label", "bits")
#: Bits of the second, wider bitmap of a leaf's root, against which single sets are held: one in eight is set at most
#: (but for a leaf of one very large set). Roots that come to the leaves in a round.
WIDE, ROOTS = 8 * LEAF_SHINGLES, 32


def wide(sets: list[bytes]) -> bytes:
    marks = np.zeros(WIDE, np.uint8)
    marks[(np.frombuffer(b"".join(sets), np.uint64) % np.uint64(WIDE)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


PLACE = ["block", "part", "leaf"]


def kept_pairs(pairs: DataFrame, least: int, scale: int) -> DataFrame:
    """Of rows (block, part, leaf, part2, leaf2, and both sides' nodes) those that may link."""

    def side(batch: pa.RecordBatch, mark: str) -> Level:
        column = lambda c: batch.column(batch.schema.get_field_index(c + mark))
        bits = np.frombuffer(b"".join(column("bits").to_pylist()), np.uint64).reshape(len(batch), -1)
        return Level(bits, *[column(c).to_numpy() for c in NODES[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.slice(first, 2048)
                at = np.arange(len(part))
                ok = may_link(side(part, ""), at, side(part, "2"), at, least, scale) if len(part) else np.zeros(0, bool)
                yield part.select([*PLACE, "part2", "leaf2"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "block long, part long, leaf long, part2 long, leaf2 long")


def sift(grown: DataFrame, base: DataFrame, pairs: DataFrame, some: list[tuple[int, int, int]], least: int, scale: int, made: list[str]) -> DataFrame:
    """(block, part2, leaf2, node, label, shingles): the sets of leaves that may link to something below one of `some`
    roots (block, part, leaf), of those that `pairs` lets them meet."""
    spark = grown.sparkSession
    of = lambda names: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(names, r, strict=True)]) for r in some], F.lit(False))
    nodes = {(r["block"], r["part"], r["leaf"]): (r["least"], r["most"], r["label"], bytes(r["wide"])) for r in base.filter(of(PLACE)).select(*PLACE, "least", "most", "label", "wide").collect()}
    asked: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
    for r in pairs.filter(of(["block", "part2", "leaf2"])).collect():
        asked.setdefault((r["block"], r["part"], r["leaf"]), []).append((r["block"], r["part2"], r["leaf2"]))
    shared = spark.sparkContext.broadcast((nodes, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        nodes, asked = shared.value
        for batch in batches:
            for k in range(len(batch)):
                roots = asked.get(tuple(batch.column(c)[k].as_py() for c in range(3)), [])
                if not roots:
                    continue
                items = batch.column(3)[k].as_py()
                sets = [np.frombuffer(x["shingles"], np.uint64) for x in items]
                sizes, labels = np.array([len(s) for s in sets], np.int64), np.array([x["label"] for x in items], np.int64)
                at, first = (np.concatenate(sets) % np.uint64(WIDE)).astype(np.int64), np.cumsum(sizes) - sizes
                for root in roots:
                    low, most, label, bits = nodes[root]
                    marks = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
                    hits = np.add.reduceat(marks[at], first, dtype=np.int64)
                    smallest = np.maximum(low, -(-least * sizes // scale))
                    ok = (labels != label) & (least * sizes <= scale * most) & (least * low <= scale * sizes) & ((scale + least) * hits >= least * (sizes + smallest))
                    left = [items[i] for i in np.flatnonzero(ok)]
                    m = len(left)
                    yield batch_of({"block": [root[0]] * m, "part2": [root[1]] * m, "leaf2": [root[2]] * m, "node": [x["node"] for x in left], "label": [x["label"] for x in left], "shingles": pa.array([x["shingles"] for x in left], pa.binary())})

    parts = sorted({(b, p) for b, p, _ in asked})
    here = reduce(lambda a, b: a | b, [(F.col("block") == b) & (F.col("part") == p) for b, p in parts], F.lit(False))
    out = cut(grown.filter(here).mapInArrow(run, "block long, part2 long, leaf2 long, node long, label long, shingles binary"), "jaccard-sifted", made, LEAVES)
    shared.destroy()
    return out


def marked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumnsRenamed({c: c + "2" for c in nodes.columns if c != "block"})


def further_links(leaves: DataFrame, blocks: DataFrame, links: DataFrame, least: int, scale: int, made: list[str], first: list[str]) -> DataFrame:
    """Links between components of the links so far, of blocks with several leaves, by dual traversal of block trees.
    The leaves' table (paths `first`) goes when its sets are dealt again."""
    labels = components(links, made)
    nodes = blocks.filter("leaves > 1").select("block", "node", "n_shingles").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    shares = nodes.groupBy("block", "label").agg(F.count("*").alias("n"))
    # sets by a component of their own, and all others of the block by size, so that leaves of far sizes don't meet
    part = F.when(F.col("n") >= OWN, F.col("label")).otherwise(-1 - F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1.2)))
    nodes = nodes.join(shares, ["block", "label"]).withColumn("part", part)
    fill = F.ceil(F.greatest(F.count("*") / LEAF, F.sum("n_shingles") / LEAF_SHINGLES)).cast("long")
    parts = nodes.groupBy("block", "part").agg(fill.alias("fill"))
    leaf = F.pmod(F.xxhash64("node"), F.col("fill")).alias("leaf")
    placed = cut(nodes.join(parts, ["block", "part"]).select("node", "label", "part", leaf), "jaccard-placed", made)
    sets = leaves.filter("leaves > 1").select("block", F.explode("sets").alias("s")).select("block", "s.*")
    grown = sets.join(placed, "node").groupBy(*PLACE).agg(F.collect_list(F.struct("node", "label", "shingles")).alias("sets"))
    grown = cut(grown, "jaccard-grown", made)
    drop(leaves.sparkSession, first)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                items = row.column(3)[0].as_py()
                top = planted(items, labels="label").levels[-1]
                yield batch_of({**dict(zip(PLACE, row.columns, strict=False)), "size": [len(items)], "least": top.least, "most": top.most, "more": top.more, "label": top.label, "bits": pa.array([top.bits[0].tobytes()], pa.binary()), "wide": pa.array([wide([x["shingles"] for x in items])], pa.binary())})

    key = "block long, part long, leaf long, "
    base = cut(grown.mapInArrow(roots, key + NODE + ", wide binary"), "jaccard-nodes", made, LEAVES)
    levels = [base.drop("wide")]
    while (levels[-1].agg(F.max("leaf")).first()[0] or 0) >= TRUNK:
        node = F.struct("size", *NODES).alias("node")
        groups = levels[-1].groupBy("block", "part", F.floor(F.col("leaf") / TRUNK).alias("leaf")).agg(F.collect_list(node).alias("children"))
        levels.append(cut(summed(groups, PLACE, key + NODE), "jaccard-nodes", made))
    top = levels.pop().drop("size")
    place = lambda mark: F.struct(F.col("part" + mark), F.col("leaf" + mark))
    ordered = "part < part2 or (part = part2 and leaf <= leaf2)"
    # roots of one component don't meet
    both = top.join(marked(top), "block").filter(ordered).filter("part <> part2 or part < 0")
    pairs = cut(kept_pairs(both, least, scale), "jaccard-pairs", made)
    while levels:
        below = levels.pop().drop("size").withColumn("up", F.floor(F.col("leaf") / TRUNK))
        up = pairs.withColumnsRenamed({"leaf": "up", "leaf2": "up2"})
        both = up.join(below, ["block", "part", "up"]).drop("up").join(marked(below), ["block", "part2", "up2"]).filter(ordered)
        pairs = cut(kept_pairs(both, least, scale), "jaccard-pairs", made)

    # down from the roots on one side: sets that may link to something below a root; a set goes only to those. Pairs of
    # leaves grow with the square of the table, so nothing is written or shuffled for each: roots come to the leaves in
    # rounds of ROOTS, and what is kept of a round is its sets
    pairs = pairs.filter(place("") != place("2"))
    there = ["block", "part2", "leaf2"]
    called = sorted(map(tuple, pairs.select(*there).distinct().collect()), key=lambda r: (r[0], r[1], r[2]))
    sifted = None
    for k in range(0, max(len(called), 1), ROOTS):
        some = called[k : k + ROOTS]
        more = sift(grown, base, pairs, some, least, scale, made)
        sifted = more if sifted is None else sifted.union(more)
    chunks = sifted.groupBy(*there).agg(F.ceil(F.count("*") / (4 * LEAF)).alias("chunks"))
    callers = sifted.join(chunks, there).groupBy(*there, F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct("node", "label", "shingles")).alias("callers"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                yield found(list(traverse(planted(x.as_py(), labels="label"), planted(y.as_py(), labels="label"), least, scale, Union())))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for sets in batch.column(0):
                t = planted(sets.as_py(), labels="label")
                yield found(list(traverse(t, t, least, scale, Union())))

    # sets that were dealt into one leaf now but not before
    inner = grown.filter("part < 0").select("sets").mapInArrow(within, LINKS)
    second = grown.withColumnsRenamed({"part": "part2", "leaf": "leaf2"})
    # callers are few beside the leaves that they come to, which so need no sorting
    return inner.union(second.join(callers.hint("shuffle_hash"), there).select("callers", "sets").mapInArrow(across, LINKS))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, least: int = 90, scale: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, representative, h, component_h) by row of docs; n_links counts the
    verified links by which the row's class was connected, representative is the class's smallest id, h the 64-bit
    hash of the text, component_h that of the component's first row by (doc_id, h). See the module."""
    made: list[str] = []
    rows = docs.select(quoted(key).cast("long").alias("doc_id"), F.xxhash64(quoted(text)).alias("h"), quoted(text).alias("text"))
    sets = cut(signatures(rows, n), "jaccard-sets", made, TEXTS)
    classes = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("digest", "short").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.select("digest", "short", F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"), "n_shingles", F.monotonically_increasing_id().alias("node"))
    classes = cut(classes, "jaccard-classes", made)
    routed = components(cut(stars(rows.filter("doc_id is not null").select("text"), n, least, scale), "jaccard-stars", made, TEXTS), made)
    blocks = routed.select(F.col("node").alias("short"), F.col("component").alias("block")).join(classes, "short").select("node", "doc_id", "h", "n_shingles", "block")
    fill = F.ceil(F.greatest(F.count("*") / LEAF, F.sum("n_shingles") / LEAF_SHINGLES)).cast("long")
    blocks = cut(blocks.join(blocks.groupBy("block").agg(fill.alias("leaves")), "block"), "jaccard-blocks", made)

    # leaves: texts are dealt, for they take less disk than their sets, and become sets again within their leaf
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                items = row.column(3).flatten()
                sets = [shingle_set(t.as_py(), n).tobytes() for t in items.field("text")]
                made_of = pa.StructArray.from_arrays([items.field("node"), pa.array(sets, pa.binary())], ["node", "shingles"])
                yield batch_of({**dict(zip(("block", "leaves", "leaf"), row.columns, strict=False)), "sets": pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), made_of)})

    leaf = F.pmod(F.xxhash64("node"), F.col("leaves"))
    # blocks grow with the table: a merge join at every size, no broadcast
    held = rows.join(blocks.hint("merge"), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "node"]).select("node", "block", "leaves", leaf.alias("leaf"), "text")
    leaves = held.groupBy("block", "leaves", "leaf").agg(F.collect_list(F.struct("node", "text")).alias("texts"))
    leaves = leaves.mapInArrow(members, "block long, leaves long, leaf long, sets array<struct<node:long,shingles:binary>>")
    first: list[str] = []
    leaves = cut(leaves, "jaccard-leaves", first, LEAVES)
    links = cut(first_links(leaves, least, scale), "jaccard-links", made, LEAVES)
    if not leaves.filter("leaves > 1").isEmpty():
        more = cut(further_links(leaves, blocks, links, least, scale, made, first), "jaccard-links", made, LEAVES)
        links = links.union(more)
    drop(docs.sparkSession, first)
    nodes = classes.join(components(links, made), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("component", F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("component_h"))
    counts = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    known = nodes.join(smallest, "component").join(counts, "node", "left").select("digest", F.col("doc_id").alias("representative"), "component_id", "component_h", "n_links")
    # the only tables that the result reads; all others go
    last: list[str] = []
    known = cut(known, "jaccard-known", last)
    kept = made.pop(0)
    drop(docs.sparkSession, made)
    made.append(kept)
    out = sets.join(known, "digest", "left")
    mine = lambda c, other: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, other))  # noqa: E731  a null id links nothing
    return out.select(
        "doc_id", "n_shingles", mine("component_id", "doc_id").alias("component_id"), F.coalesce(mine("n_links", F.lit(0)), F.lit(0)).alias("n_links"),
        mine("representative", "doc_id").alias("representative"), "h", mine("component_h", F.lit(None)).alias("component_h"),
    )
