"""Operator 7, language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly that text's substrings. A document is
cross-parsed: from each place the longest match is one phrase, and the next phrase begins after it. The language
that needs the fewest phrases per symbol wins.

The automata are built from a bounded sample: SAMPLE_DOCS documents per language of at most SLICE characters.
Workers build them once and step through all blocks of a batch together, one table lookup per symbol and language.
A text is parsed whole, in blocks of BLOCK symbols, each at most one phrase more.

Symbols are lower-case letters; all else is one separator. Every letter of the samples is a symbol of its own;
letters that no sample holds never match.

Defined results: a null text or one without a letter is "und" with score 0; with no labelled rows everything is
"und"; ties go to the smaller name; repeated rows get equal results; an empty table gives an empty result. In
predicted(), columns of docs that clash with the added names are replaced; accepted() returns every column of docs as it
was, whatever its name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import column_bytes, passes

SAMPLE_DOCS, SLICE = 160, 300
SHARES = 16
#: Bytes of the table of the most frequent letters; what other letters lead to is kept as sorted keys.
DENSE_BYTES = 1 << 26
BLOCK = 256
UNKNOWN = "und"


def training_text(labelled: DataFrame) -> dict[str, str]:
    """A bounded sample of labelled(text, lang): the same for the same rows, in whatever order."""
    d = labelled.filter("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    # the least hashes of each language, first in each of its shares, then of what is left: no language meets whole
    picks = d.select("lang", "h", F.pmod("h", F.lit(SHARES)).alias("share")).distinct()
    for keys in (["lang", "share"], ["lang"]):
        picks = picks.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("n") <= SAMPLE_DOCS)
    picks = picks.select("lang", "h")
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - SLICE + 1)).cast("int") + 1
    rows = picks.collect()  # SAMPLE_DOCS for each language
    few = labelled.sparkSession.createDataFrame(rows, "lang string, h long")
    got = d.join(F.broadcast(few), ["lang", "h"]).select("lang", "h", F.substring(F.col("text"), at, F.lit(SLICE)).alias("t")).dropDuplicates(["lang", "h"]).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got):
        out.setdefault(r["lang"], []).append(r["t"])
    return {lang: " ".join(t) for lang, t in sorted(out.items())}


class Alphabet:
    """A class for each code point: 0 separator, 1 a letter of no sample, from 2 on the letters of the samples."""

    def __init__(self, texts: list[str]):
        count = Counter(c.lower() for t in texts for c in t if c.isalpha())
        self.letters = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
        self.size = len(self.letters) + 2
        of = {c: k + 2 for k, c in enumerate(self.letters)}
        self.table = np.zeros(0x110000, dtype=np.int32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.table[code] = of.get(c.lower(), 1)

    def symbols(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes with runs of separators made one, and where each document then begins."""
        s = self.table[codes]
        keep = s != 0
        if len(s):
            again = np.zeros(len(s), dtype=bool)
            again[1:] = s[:-1] != 0
            inside = first[:-1][first[:-1] < len(s)]
            again[inside] = False
            keep |= again
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def transitions(symbols: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: by state, the next state for each symbol; state 0 is the root."""
    n = len(symbols)
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    assert len(go) <= max(1, 2 * n)
    return go


def edges(go: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, symbol and next state of each transition."""
    state = np.repeat(np.arange(len(go)), [len(t) for t in go])
    symbol = np.fromiter((c for t in go for c in t), dtype=np.int64, count=len(state))
    return state, symbol, np.fromiter((x for t in go for x in t.values()), dtype=np.int64, count=len(state))


def automaton(symbols: np.ndarray, size: int) -> np.ndarray:
    """The suffix automaton of a sequence as a table: next state, or -1."""
    go = transitions(symbols)
    state, symbol, after = edges(go)
    table = np.full((len(go), size), -1, dtype=np.int32)
    table[state, symbol] = after
    return table


class Parser:
    def __init__(self, texts: dict[str, str]):
        self.langs = list(texts)
        self.alphabet = Alphabet(list(texts.values()))
        self.size = self.alphabet.size
        found, self.roots, states = [], [], 0
        for t in texts.values():
            codes = np.array([ord(c) for c in t], dtype=np.int64)
            s, _ = self.alphabet.symbols(codes, np.array([0, len(codes)]))
            go = transitions(s)
            state, symbol, after = edges(go)
            found.append((state + states, symbol, after + states))
            self.roots.append(states)
            states += len(go)
        state, symbol, after = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        # classes are in order of frequency: the first ones make a table, the rest sorted keys with a last one that is never met
        self.dense = min(self.size, max(2, DENSE_BYTES // (4 * max(1, states))))
        near = symbol < self.dense
        self.table = np.full(states * self.dense, -1, dtype=np.int32)
        self.table[state[near] * self.dense + symbol[near]] = after[near]
        keys = state[~near] * self.size + symbol[~near]
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.after = np.append(after[~near][order], -1).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state, or -1, for states (languages in rows) and one symbol for each column."""
        if self.dense == self.size:
            return self.table[state * self.dense + symbol]
        far = symbol >= self.dense
        out = self.table[state * self.dense + np.where(far, 0, symbol)]
        if far.any():
            state = np.broadcast_to(state, out.shape)
            key = state[:, far] * self.size + symbol[far]
            at = np.searchsorted(self.keys, key)
            out[:, far] = np.where(self.keys[at] == key, self.after[at], -1)
        return out

    def phrases(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each document (rows) in each language (columns)."""
        n, langs = len(first) - 1, len(self.langs)
        lengths = np.diff(first)
        blocks = -(-lengths // BLOCK)
        doc = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[doc] + nth * BLOCK
        size = np.minimum(BLOCK, first[doc + 1] - begin)
        order = np.argsort(-size, kind="stable")  # the blocks that still go on are then a prefix
        begin, size, doc = begin[order], size[order], doc[order]
        roots = np.array(self.roots, dtype=np.int64)[:, None]
        state = np.repeat(roots, len(begin), axis=1)
        count = np.ones((langs, len(begin)), dtype=np.int32)  # the phrase that is open at the end
        live = len(begin)
        smaller = -size
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(smaller, -k, side="left"))
            c = symbols[begin[:live] + k].astype(np.int64)
            there = self.step(state[:, :live], c)
            failed = there < 0
            anew = self.step(roots, c)
            anew = np.where(anew < 0, roots, anew)
            state[:, :live] = np.where(failed, anew, there)
            count[:, :live] += failed
        out = np.zeros((n, langs), dtype=np.int64)
        for j in range(langs):
            out[:, j] = np.bincount(doc, weights=count[j], minlength=n)
        return out


def _parser(texts: dict[str, str], kept: dict = {}) -> Parser:  # noqa: B006  one for each worker process
    key = tuple(texts.items())
    if kept.get("key") != key:
        kept["parser"], kept["key"] = Parser(texts), key
    return kept["parser"]


def predicted(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """docs with lang_pred, score (0.5 when the two best are alike, to 1) and phrase_rate (phrases per symbol of the best)."""
    langs = [*texts, UNKNOWN]
    # only text goes to Python beside a row's own columns, which come back unchanged
    names = [f.name for f in docs.schema if f.name not in ("lang_pred", "score", "phrase_rate")]
    d = docs.select(*names)
    schema = StructType([*d.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("phrase_rate", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _parser(texts)
        for batch in batches:
            raw, offsets = column_bytes(batch.column(names.index("text")))
            best, score, rate = [], [], []
            for a, b in passes(offsets):
                part = raw[offsets[a] : offsets[b]]
                codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets[a : b + 1] - offsets[a]]
                s, first = p.alphabet.symbols(codes, chars)
                letters = np.diff(np.concatenate([[0], np.cumsum(s != 0)])[first])
                if not p.langs:
                    letters[:] = 0
                got = p.phrases(s, first) / np.maximum(1, np.diff(first))[:, None] if p.langs else np.zeros((b - a, 1))
                k = np.argmin(got, axis=1)
                low = np.partition(got, 1, axis=1) if got.shape[1] > 1 else np.concatenate([got, got * 0 + 1], axis=1)
                best += np.where(letters > 0, k, len(p.langs)).tolist()
                score.append(np.where(letters > 0, low[:, 1] / np.maximum(low[:, 0] + low[:, 1], 1e-12), 0.0))
                rate.append(np.where(letters > 0, low[:, 0], 1.0))
            done = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([langs[k] for k in best], pa.string()), done(score), done(rate)], names=schema.names)

    return d.mapInArrow(run, schema)


def accepted(docs: DataFrame, texts: dict[str, str], most_rate: float = 0.6) -> DataFrame:
    """The documents that read as one of the languages: a letter at least, and phrases of 1 / most_rate symbols on average."""
    own = [c if c == "text" else f"_column{k}" for k, c in enumerate(docs.columns)]  # no clash with added names
    kept = predicted(docs.toDF(*own), texts).filter((F.col("lang_pred") != UNKNOWN) & (F.col("phrase_rate") <= most_rate))
    return kept.select(*own).toDF(*docs.columns)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in this part; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
