"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Words of the mixing and n-gram contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster for cut lineage. One of our own only for a session within one machine (tests);
    on a cluster it must be set, for executors don't share local folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geoquill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of a batch to Python, where `cut` is given records: a row over it goes alone.
BYTES, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def cut(df: DataFrame, name: str, made: list[str] | None = None, records: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later stages depend on files, not on lost executors,
    and the planner knows its true size. Shuffle files of the plan, which runs once, go when the table is written.
    The path is added to `made`. Python gets `records` rows at once at most, if given: buffers on both sides grow with
    them."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    most = int(spark.conf.get(RECORDS))
    ours = {CLEANUP: "true"}
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), RECORDS: str(most), BYTES: spark.conf.get(BYTES)}
    if records:
        ours |= {RECORDS: str(min(records, most) if most > 0 else records), BYTES: str(MOST)}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes cut tables that no remaining plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


_kept: dict[object, object] = {}


def keep_alone(key: object, make: Callable[[], T]) -> T:
    """What a Python worker remembers from task to task. Workers serve one operator after another, so what another one
    has left goes first: an executor holds one such memory a worker, not one for each operator that ran before."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]  # type: ignore[return-value]


def forget() -> None:
    """Frees what other operators have left in this worker."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def unit(digest: Column) -> Column:
    """A hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def digest(key: Column, text: Column) -> Column:
    """Digest of a row's key; of its text where the key is null."""
    return F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("text "), text), F.lit("")).cast("binary"))


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of df that outputs of these names don't replace."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# -- vectorised word hashing for Arrow batches -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WEIGHT = _FOLD.astype(np.uint64) + np.uint64(1)
_UNDO = pow(int(_BASE), -1, 1 << 64)
_powers = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers (shift, xor and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hashes, byte starts and ends of the words of a text (A-Z folded), and its folded bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return *byte_word_hashes(raw), _FOLD[raw].tobytes()


def byte_word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a text's bytes."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    # position-weighted byte sums: sum(byte * base^i) over a word, brought to a common position by
    # the power that is missing up to the longest place in the text
    p = powers(len(raw) + 1)
    acc = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_WEIGHT[raw] * p[: len(raw)], out=acc[1:])
    h = (acc[ends] - acc[starts]) * p[len(raw) - starts]
    # the common factor base^len(raw) is undone so that equal words of different texts agree
    h = h * np.uint64(pow(_UNDO, len(raw), 1 << 64))
    return mix64(h ^ (ends - starts).astype(np.uint64)), starts, ends


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hashes of all runs of n words; fewer words: the whole run as one; none: empty."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i])
    return out
