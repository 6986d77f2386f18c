"""What several operators share: tables written to the shared folder, and numpy over the bytes of an Arrow column.

Text is looked at as UTF-8 bytes in whole Arrow batches, so that words, word hashes and window hashes of
thousands of documents come from a few vectorised passes instead of a Python loop over words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the contracts' words: space and \x09-\x0D.
WORD_SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised pass looks at; longer documents are passes of their own.
PASS_BYTES = 1 << 19
#: Rows that a task hands to Python at once.
BATCH_ROWS = 2000

_U = np.uint64
_R, _S = _U(0x9E3779B97F4A7C17), _U(0xD6E8FEB86659FD95)
_RI, _SI = _U(pow(int(_R), -1, 1 << 64)), _U(pow(int(_S), -1, 1 << 64))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session has a new temporary one, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Settings of a job that writes a table: its shuffle files go once the table is there, and Python gets rows in small batches."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    spark = table.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def keyed(docs: DataFrame) -> DataFrame:
    """id (null: after all others) and key tell a row from others; alike rows are one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: np.uint64, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006  the memo of this process
    have = kept.get(base)
    if have is None or len(have) < n:
        size = max(n, PASS_BYTES + (PASS_BYTES >> 3))
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        kept[base] = have = np.multiply.accumulate(have)
    return have[:n]


def byte_table(lower: bool, seed: int = 0) -> np.ndarray:
    """A random 64-bit value for each byte; with lower, A-Z have the values of a-z."""
    t = mix(np.arange(1, 257, dtype=_U) + _U(seed * 1000))
    if lower:
        t[65:91] = t[97:123]
    return t


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first n bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Sums of pseudo-random functions of a word's chunks of eight bytes and their places: no polynomial, so no words with a pattern in common collide.

    Words of at most eight bytes differ in their one chunk or length, and mix() is bijective.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    key = mix(_U([seed + 1]))
    length = ends - starts
    total = mix((eight[starts] & _FIRST[np.minimum(length, 8)]) + key)
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) >> 3  # chunks after the first
        begin = np.cumsum(more) - more
        j = np.arange(int(more.sum())) - np.repeat(begin, more) + 1
        at = np.repeat(starts[long], more) + 8 * j
        chunk = eight[at] & _FIRST[np.minimum(np.repeat(ends[long], more) - at, 8)]
        total[long] += np.add.reduceat(mix(mix(chunk + key) + j.astype(_U) * _R), begin)
    return mix(total + length.astype(_U) * _S)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together, or one document."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of some documents: starts and ends in bytes; first[d] is the place of document d's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        self.raw, self.offsets = raw, offsets
        inside = ~separator[raw]
        before = np.empty_like(inside)
        if len(raw):
            before[0] = False
            before[1:] = inside[:-1]
            cuts = offsets[:-1][offsets[:-1] < len(raw)]
            ends_at_cut = cuts[(cuts > 0) & inside[cuts - 1] & (cuts < len(raw))] if len(cuts) else cuts
            before[cuts] = False
        self.starts = np.flatnonzero(inside & ~before)
        if len(raw):
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            after[ends_at_cut - 1] = False
            self.ends = np.flatnonzero(inside & ~after) + 1
        else:
            self.ends = self.starts
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word (with lower, of its A-Z as a-z), from stretches of about PASS_BYTES, so a long text needs no more memory than its words."""
        out = np.empty(len(self.starts), dtype=_U)
        k = 0
        while k < len(out):
            base = self.starts[k]
            stop = max(k + 1, int(np.searchsorted(self.ends, base + PASS_BYTES, side="right")))
            part = self.raw[base : self.ends[stop - 1]]
            out[k:stop] = _word_hashes(_LOWER[part] if lower else part, self.starts[k:stop] - base, self.ends[k:stop] - base, seed)
            k = stop
        return out

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


def separators(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


def windows(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of width words, by the place of its first word."""
    n = len(word_hashes)
    if n < width:
        return np.zeros(0, dtype=_U)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(word_hashes * _powers(_S, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * _powers(_SI, n + 1)[: n - width + 1])


def within(first: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the n - width + 1 runs stay in one document."""
    ok = np.ones(max(0, n - width + 1), dtype=bool)
    for k in range(1, width):  # a run that begins k words before a document's end is too short
        at = first[1:] - k
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok
