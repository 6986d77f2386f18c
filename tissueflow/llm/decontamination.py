"""Operator 4, benchmark decontamination: a BM25 inverted index of test items, queried with every training passage.

Items are indexed by classes of their length, each up to twice as long as the one before. For each class, texts are cut into passages of
twice its longest length, each half a passage after the last, so every copy of an item lies whole in some passage, and a long item
does not make the passages of short ones long. A passage is a query to the index by block-max WAND, for many passages at once:

1. A passage's terms are put in order of the most that each can add to any item. An item that holds only terms before
   the pivot, where the bounds first sum to the threshold, cannot reach it; these are the frequent terms, and their
   postings are never walked for candidates.
2. The others' postings are walked by blocks of ITEMS_BLOCK items. Blocks in which the block bounds and the bounds of
   the terms before the pivot stay below the threshold are skipped.
3. For blocks that are left, the block bounds of the terms before the pivot are looked up, largest first; a block goes as
   soon as what is still to come cannot lift it to the threshold. What stays is scored in full.

Scores are shares of what the item scores against itself; all items at THRESHOLD or more are retrieved, without a
limit. Each is then verified in the document: the share of the five-word shingles of its question (all sentences but the
last) and of its answer (the last) must both reach OVERLAP, or that of the whole item.

The index is built from items in parts of at most ITEMS, so what is sent to workers is bounded; a larger benchmark means
more passes over the texts, with the frequencies of the whole benchmark in each. Passages are
searched in groups whose arrays hold at most ENTRIES numbers (or one passage), so memory does not grow with a text's length
beyond a few numbers for each word.

Defined results: null and empty texts hold nothing; items without words match nothing; items alike in text all
match; an item without an id is reported as -1; repeated rows get equal results; an empty table on either side gives no leaks; columns other than those named are
ignored by leaks() and come back unchanged from clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column_bytes, passes, windows

THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
ITEMS = 20_000
ITEMS_BLOCK = 4
#: Numbers in an array of one group of passages.
ENTRIES = 1 << 20
K1, B = 1.2, 0.75
_SEED = 4
_NOT_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_SENTENCE_END = np.array([chr(b) in ".!?\n" for b in range(256)])


def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return raw, np.array([0, len(raw)])


def _shingles(h: np.ndarray) -> tuple[int, np.ndarray]:
    """Width and distinct runs of SHINGLE words; fewer words: the whole run."""
    width = min(SHINGLE, len(h))
    return width, np.unique(windows(h, width))


def item_words(text: str | None) -> tuple[np.ndarray, int]:
    """Hashes of an item's words, and how many of them are its question."""
    raw, offsets = _bytes(text or "")
    w = Words(raw, offsets, _NOT_WORD)
    h = w.hashes(_SEED, lower=True)
    if not len(h):
        return h, 0
    # the answer begins after the last sentence end that has words behind it
    ends = np.concatenate([[0], np.cumsum(_SENTENCE_END[raw])])[w.starts]
    return h, int(np.searchsorted(ends, ends[-1])) or 2 * len(h) // 3  # one sentence: its last third


@dataclass(frozen=True)
class Benchmark:
    """What scores need to know of all items, whatever part of them an index holds."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which number in it, for all numbers of the ranges from first up to last."""
    n = last - first
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _groups(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive entries whose sizes sum to most at the most, or one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, most + (ends[a - 1] if a else 0), side="right")))
        yield slice(a, b)
        a = b


def length_class(words: int) -> int:
    return max(0, words - 1).bit_length()


class Index:
    """Postings by term in item order: items and impacts (shares of the item's own score), and each block's largest impact."""

    def __init__(self, items: list[tuple[int, str]], of: Benchmark | None = None):
        self.ids, self.parts, words = [], [], []
        for item, text in items:
            h, cut = item_words(text)
            if len(h):
                self.ids.append(item)
                question, answer = (h[:cut], h[cut:]) if cut else (h, h)
                self.parts.append([_shingles(h), _shingles(question), _shingles(answer)])
                words.append(h)
        n, lengths = len(words), np.array([len(h) for h in words], dtype=np.int64)
        self.terms, t = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        key, tf = np.unique(t.astype(np.int64) * max(1, n) + np.repeat(np.arange(n), lengths), return_counts=True)
        t, self.posting = np.divmod(key, max(1, n))
        df = np.bincount(t, minlength=len(self.terms))
        if of is None:
            of = Benchmark(n, float(lengths.mean()) if n else 1.0, self.terms, df)
        df = of.df[np.searchsorted(of.terms, self.terms)]
        self.longest = 1 << length_class(int(lengths.max(initial=1)))  # the same in every part of a benchmark
        score = np.log(1 + (of.n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.posting] / of.mean))
        self.impact = score / np.bincount(self.posting, weights=score, minlength=n)[self.posting]
        self.first = np.searchsorted(t, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(t) else np.zeros(0)
        # blocks of items that a term's postings touch, one term after another: block_key is in order
        self.n_blocks = max(1, -(-n // ITEMS_BLOCK))
        block = t * self.n_blocks + self.posting // ITEMS_BLOCK
        self.block_key, begin = np.unique(block, return_index=True)
        self.block_first = np.append(begin, len(t))
        self.block_most = np.maximum.reduceat(self.impact, begin) if len(t) else np.zeros(0)
        self.first_block = np.searchsorted(self.block_key, np.arange(len(self.terms) + 1) * self.n_blocks)

    @cached_property
    def items(self) -> list[np.ndarray]:
        return np.split(self.posting, self.first[1:-1])

    @cached_property
    def impacts(self) -> list[np.ndarray]:
        return np.split(self.impact, self.first[1:-1])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The term of each word hash, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose impacts over the terms sum to threshold or more."""
        _, item, score = self.search_all(np.zeros(len(terms), np.int64), np.array(terms, dtype=np.int64), threshold)
        return list(zip(item.tolist(), score.tolist(), strict=True))

    def search_all(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """passage, item and score of all items that reach the threshold, for the distinct terms of each passage (numbered from 0)."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(term):
            order = np.lexsort((self.most[term], passage))
            passage, term = passage[order], term[order]
            first = np.searchsorted(passage, np.arange(int(passage[-1]) + 2))
            total = np.concatenate([[0.0], np.cumsum(self.most[term])])
            late = total[1:] - total[first[passage]] >= threshold - 1e-9
            walked = np.where(late, self.first_block[term + 1] - self.first_block[term], 0)
            walked = np.diff(np.concatenate([[0], np.cumsum(walked)])[first])
            size = np.where(walked > 0, np.maximum(walked, self.n_blocks), 0)
            for g in _groups(size, ENTRIES):
                a, b = first[g.start], first[g.stop]
                if size[g].any():
                    p, item, score = self._walk(passage[a:b] - g.start, term[a:b], late[a:b], threshold - 1e-9)
                    found.append((p + g.start, item, score))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _walk(self, passage: np.ndarray, term: np.ndarray, late: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = int(passage[-1]) + 1
        early = np.bincount(passage[~late], weights=self.most[term[~late]], minlength=n)
        which, at = _spread(self.first_block[term[late]], self.first_block[term[late] + 1])
        cell = passage[late][which] * self.n_blocks + self.block_key[at] % self.n_blocks
        bound = np.bincount(cell, weights=self.block_most[at], minlength=1)
        cell = np.flatnonzero(bound)
        where, block = np.divmod(cell, self.n_blocks)
        have, rest = bound[cell], early[where]
        live = have + rest >= slack
        where, block, have, rest = where[live], block[live], have[live], rest[live]
        # the terms before the pivot, from the largest bound down
        first = np.searchsorted(passage, np.arange(n))
        next_ = first + np.bincount(passage[~late], minlength=n) - 1
        step = 0
        while True:
            more = next_[where] - step >= first[where]
            if not more.any():
                break
            t = term[np.maximum(next_[where] - step, 0)]
            key = t * self.n_blocks + block
            at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            have += np.where(more & (self.block_key[at] == key), self.block_most[at], 0.0)
            rest -= np.where(more, self.most[t], 0.0)
            live = have + rest >= slack
            where, block, have, rest, step = where[live], block[live], have[live], rest[live], step + 1
        last = np.append(first[1:], len(passage))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for g in _groups((last - first)[where], ENTRIES // ITEMS_BLOCK):  # full scores of what is left
            which, at = _spread(first[where[g]], last[where[g]])
            key = term[at] * self.n_blocks + block[g][which]
            at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            held = self.block_key[at] == key
            which, at = which[held], at[held]
            pair, at = _spread(self.block_first[at], self.block_first[at + 1])
            cell = which[pair] * ITEMS_BLOCK + self.posting[at] % ITEMS_BLOCK
            score = np.bincount(cell, weights=self.impact[at], minlength=1)
            cell = np.flatnonzero(score >= slack)
            found.append((where[g][cell // ITEMS_BLOCK], block[g][cell // ITEMS_BLOCK] * ITEMS_BLOCK + cell % ITEMS_BLOCK, score[cell]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def leaks(self, w: Words, threshold: float, overlap: float, h: np.ndarray | None = None) -> Iterator[tuple[int, int, float, float, float, float]]:
        """document, item, score, and shares of the question, the answer and the whole item, best passage of each."""
        h = w.hashes(_SEED, lower=True) if h is None else h
        term = self.lookup(h)
        half = self.longest
        count = np.diff(w.first)
        many = np.maximum(1, -(-count // half) - 1) * (count > 0)
        first = np.cumsum(many) - many
        doc = np.repeat(np.arange(len(count)), many)
        begin = w.first[doc] + (np.arange(len(doc)) - first[doc]) * half
        stop = np.minimum(begin + 2 * half, w.first[doc + 1])
        best: dict[tuple[int, int], tuple] = {}
        for p, item, score in self._retrieved(w, term, first, many, threshold):
            key = (int(doc[p]), item)
            whole, question, answer = self._shares(h[begin[p] : stop[p]], item)
            if whole >= overlap or min(question, answer) >= overlap:
                best[key] = max(best.get(key, (0.0,)), (score, question, answer, whole))
        for (d, item), (score, question, answer, whole) in best.items():
            yield d, self.ids[item], score, question, answer, whole

    def _retrieved(self, w: Words, term: np.ndarray, first: np.ndarray, many: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """Passages, the items that they retrieve and their scores."""
        at = np.flatnonzero(term >= 0)
        if not len(at):
            return
        doc = w.doc_of(at)
        nth = (at - w.first[doc]) // self.longest
        # a word stands in the passage that begins in its half, and in the one before; the last one goes on to the end
        here, before = nth < many[doc], nth > 0
        passage = np.concatenate([(first[doc] + nth)[here], (first[doc] + nth - 1)[before]])
        pair = np.unique(passage * len(self.terms) + np.concatenate([term[at][here], term[at][before]]))
        passage, t = np.divmod(pair, len(self.terms))
        for p, item, score in zip(*self.search_all(passage, t, threshold), strict=True):
            yield int(p), int(item), float(score)

    def _shares(self, h: np.ndarray, item: int) -> list[float]:
        """Shares of the shingles of the whole item, its question and its answer that stand in a passage."""
        have: dict[int, np.ndarray] = {}
        shares = []
        for width, s in self.parts[item]:
            if width not in have:
                have[width] = np.unique(windows(h, width))
            shares.append(float(np.isin(s, have[width]).mean()))
        return shares


class Classes:
    """An index for each class of lengths, with the frequencies of all items."""

    def __init__(self, items: list[tuple[int, str]], of: Benchmark | None = None):
        classes: dict[int, list] = {}
        for item in items:
            if n := len(item_words(item[1])[0]):
                classes.setdefault(length_class(n), []).append(item)
        if of is None and len(classes) > 1:
            every = [item_words(text)[0] for _, text in items]
            every = [h for h in every if len(h)]
            terms, df = np.unique(np.concatenate([np.unique(h) for h in every]), return_counts=True)
            of = Benchmark(len(every), float(np.mean([len(h) for h in every])), terms, df)
        self.indexes = [Index(classes[c], of) for c in sorted(classes)]

    def leaks(self, w: Words, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float, float]]:
        """What the indexes find in some documents."""
        h = w.hashes(_SEED, lower=True)
        for index in self.indexes:
            yield from index.leaks(w, threshold, overlap, h)


def _index(part: tuple, kept: dict = {}) -> Classes:  # noqa: B006  one for each worker process
    items, of = part
    key = hash(tuple(items))
    if kept.get("key") != key:
        kept["index"], kept["key"] = Classes(items, of), key
    return kept["index"]


def parts_of(items: DataFrame, size: int = ITEMS) -> Iterator[tuple[list[tuple[int, str]], Benchmark | None]]:
    """The benchmark in bounded parts; with several, what scores need to know of all of it (None: the part is the whole)."""
    items = items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-items.count() // (size // 2)))  # hashed parts are even enough to stay below size
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    if parts > 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    h, _ = item_words(text)
                    terms = np.unique(h).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(terms), pa.int64()), pa.array(terms), pa.array([len(h)] * len(terms), pa.int64()), pa.array(np.arange(len(terms)) == 0)], names=["part", "term", "words", "head"])

        words = items.select("text", "part").mapInArrow(run, "part long, term long, words long, head boolean")
        n, mean = words.filter("head").agg(F.count("*"), F.avg("words")).first()
        df = words.groupBy("term").agg(F.count("*").alias("df"))
    for k in range(parts):
        own, of = items.filter(F.col("part") == k), None
        if parts > 1:
            rows = words.filter(F.col("part") == k).select("term").distinct().join(df, "term").collect()  # the terms of one part
            table = np.array([(r["term"], r["df"]) for r in rows], dtype=np.int64).reshape(-1, 2)
            order = np.argsort(table[:, 0].astype(np.int64).view(np.uint64))
            of = Benchmark(n, mean or 1.0, np.ascontiguousarray(table[order, 0]).view(np.uint64), table[order, 1])
        yield sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in own.collect()), of


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question, answer and whole (shares) of every document that holds an item."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "item_id", "score", "question", "answer", "whole"]
    found = None
    for part in parts_of(items):

        def run(batches: Iterator[pa.RecordBatch], part: tuple = part) -> Iterator[pa.RecordBatch]:
            index = _index(part)
            for batch in batches:
                ids, rows = batch.column(0), []
                raw, offsets = column_bytes(batch.column(1))
                for a, b in passes(offsets):
                    w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _NOT_WORD)
                    rows += [(ids[a + k].as_py(), *x) for k, *x in index.leaks(w, threshold, overlap)]
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        some = d.mapInArrow(run, "doc_id long, item_id long, score double, question double, answer double, whole double")
        found = some if found is None else found.union(some)
    return found


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs without those that hold an item; no shuffle, rows pass through."""
    text = docs.columns.index("text")
    out = docs
    for part in parts_of(items):

        def run(batches: Iterator[pa.RecordBatch], part: tuple = part) -> Iterator[pa.RecordBatch]:
            index = _index(part)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                raw, offsets = column_bytes(batch.column(text))
                for a, b in passes(offsets):
                    w = Words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _NOT_WORD)
                    for k, *_ in index.leaks(w, threshold, overlap):
                        keep[a + k] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
