"""Operator 4 on many items and long texts, in parts, and against full scoring."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np

from tissueflow.llm import decontamination as dc

LONG = """
import itertools, random, sys
from tissueflow.llm import decontamination as dc
from tissueflow.llm.common import Words
import numpy as np
rng = random.Random(1)
vocab = [f"w{k}" for k in range(30000)]
weights = list(itertools.accumulate(1 / (j + 1) for j in range(30000)))
items = [(k, " ".join(rng.choices(vocab, cum_weights=weights, k=12))) for k in range(20000)]
index = dc.Index(items)
words = rng.choices(vocab, cum_weights=weights, k=int(sys.argv[1]) // 5)
words[1000:1000] = items[77][1].split()
raw = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
got = {i for _, i, *_ in index.leaks(Words(raw, np.array([0, len(raw)]), dc._NOT_WORD), dc.THRESHOLD, dc.OVERLAP)}
assert 77 in got
peak = next(x for x in open("/proc/self/status") if x.startswith("VmHWM"))  # of this program alone; ru_maxrss begins with the parent's
print(len(raw), int(peak.split()[1]) // 1024)
"""


def test_memory_of_a_long_text():
    """20,000 items and a text of some MB; one of 10 MB took 98 s and stayed below 1 GB."""
    out = subprocess.run([sys.executable, "-c", LONG, str(2_000_000)], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True).stdout.split()
    assert int(out[0]) > 1_600_000 and int(out[1]) < 500, out


def test_many_passages_against_full_scores():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    weights = [1 / (j + 1) for j in range(300)]
    items = [(k, " ".join(rng.choices(vocab, weights, k=rng.randint(2, 15)))) for k in range(700)]
    index = dc.Index(items)
    n, picked = 400, []
    for _ in range(n):
        terms = np.unique(index.lookup(dc.item_words(" ".join(rng.choices(vocab, weights, k=40)))[0]))
        picked.append(terms[terms >= 0])
    passage = np.repeat(np.arange(n), [len(t) for t in picked])
    for threshold in (0.2, 0.6, 0.95):
        p, item, score = index.search_all(passage, np.concatenate(picked), threshold)
        want = {}
        for k, terms in enumerate(picked):
            total = np.zeros(len(index.ids))
            for t in terms:
                total[index.items[t]] += index.impacts[t]
            want |= {(k, int(i)): total[i] for i in np.flatnonzero(total >= threshold - 1e-9)}
        got = dict(zip(zip(p.tolist(), item.tolist(), strict=True), score, strict=True))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 20


def test_small_groups_give_the_same(monkeypatch):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(2, 9)))) for k in range(200)]
    passage, term = np.repeat(np.arange(50), 30), np.concatenate([rng.sample(range(80), 30) for _ in range(50)])
    search = lambda: sorted(zip(*(x.tolist() for x in dc.Index(items).search_all(passage, term, 0.6)), strict=True))
    whole = search()
    monkeypatch.setattr(dc, "ENTRIES", 16)
    assert [(a, b, round(c, 9)) for a, b, c in search()] == [(a, b, round(c, 9)) for a, b, c in whole] and whole


def test_parts_give_what_the_whole_gives(spark, monkeypatch):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(3, 30))) for _ in range(120)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None), (500, ""), (501, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(rng.choices(vocab, k=50)) + " " + t + " " + " ".join(rng.choices(vocab, k=k))) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = lambda: sorted((r["doc_id"], r["item_id"], *(round(r[c], 9) for c in ("score", "question", "answer", "whole"))) for r in dc.leaks(docs, items).collect())
    whole = rows()
    monkeypatch.setattr(dc.parts_of, "__defaults__", (20,))
    assert len(list(dc.parts_of(items))) > 5 and rows() == whole and len(whole) >= 121


def test_a_long_item_does_not_slow_the_short_ones():
    """Short items keep short passages: the same leaks, and no multiple of the time, with one very long item beside them."""
    import time

    from tissueflow.llm.common import Words

    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(5000)]
    pick = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, pick(12)) for k in range(500)]
    long = (9999, pick(6000))
    text = pick(30_000).split()
    for k in (3, 77, 401):
        at = rng.randrange(len(text))
        text[at:at] = items[k][1].split()
    raw = np.frombuffer(" ".join(text).encode(), dtype=np.uint8)
    found, took = [], []
    for more in ([], [long]):
        index = dc.Classes(items + more)
        best = []
        for _ in range(3):
            start = time.process_time()
            got = {i for _, i, *_ in index.leaks(Words(raw, np.array([0, len(raw)]), dc._NOT_WORD), dc.THRESHOLD, dc.OVERLAP)}
            best.append(time.process_time() - start)
        found.append(got)
        took.append(min(best))
    assert found[0] == found[1] == {3, 77, 401} and took[1] < 12 * took[0] + 0.1  # some 40 times with one passage length for all
    raw = np.frombuffer(long[1].encode(), dtype=np.uint8)
    assert {i for _, i, *_ in index.leaks(Words(raw, np.array([0, len(raw)]), dc._NOT_WORD), dc.THRESHOLD, dc.OVERLAP)} == {9999}
