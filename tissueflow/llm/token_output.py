"""Operator 1, token-ID output: each shard is one compressed Parquet file of wavelet-matrix blocks.

The documents are range-partitioned by doc_id (the only shuffle) into shards of about SHARD_BYTES of text, each shard encodes
its texts in order and writes blocks of about BLOCK_TOKENS ids at document borders (a longer document is a block of its own).
Spark's writer commits the files, so a lost or repeated task leaves no half-written shard, and any store that Spark reaches will do.

Defined results: a null text is an empty document (the end id alone); a null doc_id sorts first; equal doc_ids
stay separate documents, ordered by text; columns other than doc_id and text are ignored; an empty table gives
no blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column_bytes, passes, shared_folder, writing
from .wavelet import WaveletMatrix

BLOCK_TOKENS = 1 << 19
SHARD_BYTES = 1 << 27
#: Bytes of text whose pre-tokens are looked up together, each distinct one once.
ENCODED_BYTES = 1 << 22
#: Pre-tokens that a worker remembers in each of two generations: what the newer one lacks is first looked for in the older.
REMEMBERED = 200_000
END_ID = 1

BLOCKS = "shard int, block int, first long, n_tokens long, bits int, planes array<binary>, zeros array<long>, ranks array<binary>, doc_ids array<long>, doc_tokens array<long>"

# What the tokenizer file must say of normalisation and splitting for pre-tokens to be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# The white space that separates words of simple texts.
WHITE = b" \t\n\x0b\x0c\r"
# Endings after an apostrophe that SPLIT takes as one pre-token.
SHORT_ENDINGS, LONG_ENDINGS = b"stmd", (b"re", b"ve", b"ll")
#: Texts without such a character: no normalisation changes them but lower case, and white space is where the tokenizer sees it.
_NOT_SIMPLE = "[^\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-ÿ]"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as one character: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    """What each byte of a simple text in lower case is: 0 white space, 1 letter, 2 digit, 3 other."""
    t = np.full(256, 3, dtype=np.uint8)
    t[list(WHITE)] = 0
    t[ord("a") : ord("z") + 1] = 1
    t[128:] = 1
    t[ord("0") : ord("9") + 1] = 2
    return t


_CLASS = _classes()


def pre_tokens(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pre-tokens of simple texts in lower case, as SPLIT makes them, and how many each text has."""
    raw, offsets = column_bytes(texts)
    n = len(raw)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(len(texts), dtype=np.int64)
    kind = _CLASS[raw]
    fresh = np.zeros(n + 1, dtype=bool)  # where a text begins
    fresh[offsets] = True
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == 2
    start |= fresh[:n]
    start &= kind != 0
    at = np.flatnonzero((raw == ord("'")) & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == 1) & ~fresh[at + 1]]
    if len(at):
        after = raw[at + 1]
        short = np.isin(after, list(SHORT_ENDINGS))
        second = np.where((at + 2 < n) & ~fresh[at + 2], raw[np.minimum(at + 2, n - 1)], 0)
        long = np.zeros(len(at), dtype=bool)
        for x, y in LONG_ENDINGS:
            long |= (after == x) & (second == y)
        start[at[short | long] + 1] = False
        stop = np.concatenate([at[short] + 2, at[long] + 3])
        stop = stop[stop < n]
        start[stop] |= kind[stop] == 1
    solid = kind != 0
    starts = np.flatnonzero(start)
    ends = np.zeros(len(starts) + 1, dtype=np.int64)  # without white space the pre-tokens stand side by side
    if len(starts):
        np.cumsum(np.add.reduceat(solid, starts, dtype=np.int64), out=ends[1:])
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw[solid]))
    return pieces, np.diff(np.searchsorted(starts, offsets))


def strings(texts: pa.Array) -> list[str]:
    """The values of an array of strings without white space, faster than one by one."""
    if not len(texts):
        return []
    one = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(one, pa.scalar(" ", texts.type))[0].as_py().split(" ")


class Known(dict):
    """The ids of pre-tokens, as bytes; an unknown one is encoded and remembered."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            got = self.encode(part)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[part] = got
        return got


class Encoder:
    """The tokenizers library, asked once for each distinct pre-token.

    BPE never crosses a pre-token, so the ids of a text are those of its pre-tokens in order. Texts with characters that
    _NOT_SIMPLE names go to the library whole, and so do all texts if the file's normalisation or splitting is another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bits = max(1, (self.whole.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.by_part = file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and file["model"]["type"] == "BPE" and not file["model"].get("dropout")
        self.model, self.letters, self.known = self.whole.model, _byte_letters(), Known(self._part, REMEMBERED)
        self.four = [k.to_bytes(4, "little") for k in range(1 << self.bits)]
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.four[t.id] for t in self.model.tokenize(letters)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        low = pc.utf8_lower(texts)
        odd = pc.match_substring_regex(texts, _NOT_SIMPLE) if self.by_part else pa.array(np.ones(len(texts), dtype=bool))
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(low, token))
        pieces, per_text = pre_tokens(pc.if_else(odd, "", low))
        found = pieces.dictionary_encode()
        ids = list(map(self.known.__getitem__, strings(found.dictionary)))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        of = found.indices.to_numpy()
        n = sizes[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[of] - ends[:-1], n)]
        counts = np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(odd):
            return flat, counts
        pieces = np.split(flat, np.cumsum(counts)[:-1])
        for k in odd.tolist():
            pieces[k] = np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype="<u4")
            counts[k] = len(pieces[k])
        return np.concatenate(pieces), counts


def _encoder(path: str, kept: dict = {}) -> Encoder:  # noqa: B006  one for each worker process
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Write the ids of docs(doc_id, text) to path, in ascending doc_id order over the shards."""
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        bits = max(enc.bits, int(end_id).bit_length())
        block, first, waiting, parts, ids, sizes = 0, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            wm = WaveletMatrix.build(flat, bits)
            row = [shard, block, first, len(flat), wm.bits, [p.tobytes() for p in wm.planes], wm.zeros, [s.tobytes() for s in wm.samples], np.concatenate(ids), np.concatenate(sizes)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, _ARROW, strict=True)], names=_NAMES)

        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            _, offsets = column_bytes(texts)
            for a, b in passes(offsets, ENCODED_BYTES):
                flat, n = enc(texts.slice(a, b - a))
                flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
                ends, doc_ids = np.cumsum(n), batch.column(0).slice(a, b - a)
                k = 0
                while k < b - a:  # up to the document that fills the block
                    base = int(ends[k - 1]) if k else 0
                    stop = min(b - a, int(np.searchsorted(ends, base + BLOCK_TOKENS - waiting)) + 1)
                    parts.append(flat[base : ends[stop - 1]])
                    ids.append(np.array(doc_ids.slice(k, stop - k).to_pylist(), dtype=object))
                    sizes.append(n[k:stop])
                    waiting += len(parts[-1])
                    if waiting >= BLOCK_TOKENS:
                        yield flush()
                        block, first, waiting, parts, ids, sizes = block + 1, first + waiting, 0, [], [], []
                    k = stop
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    with writing(spark):
        ordered.mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path)


_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["bits"], row["planes"], row["zeros"], row["ranks"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    start needs one sum per shard, not one per document: blocks carry their place in the shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(_NAMES)}
                ids = matrix(row).decode()
                ends = np.cumsum(row["doc_tokens"], dtype=np.int64)
                starts = ends - row["doc_tokens"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    found = blocks.mapInArrow(digest, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return found.join(base, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "shard")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Where a token stands: shard, place in the shard. Counting and lookup use rank and select, nothing is decoded."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(_NAMES) if not n.startswith("doc_")}
                wm = matrix(row)
                at = [row["first"] + wm.select(token, j) for j in range(wm.rank(token, wm.n))]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(at), pa.int32()), pa.array(at, pa.int64())], names=["shard", "place"])

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(locate, "shard int, place long")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Write docs to path (by default a new folder beside the checkpoints) and return what the files say of each document."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, shards=shards)
    return read(spark, path)
