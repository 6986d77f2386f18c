"""Operator 11 against a plain ranking of all documents."""

import math
import re
from collections import Counter, defaultdict

from tissueflow.llm import ranked

ITEMS = "item_id long, text string, score string, rank int"


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=50):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    of, out = defaultdict(set), []
    for i, t in items:
        of[i] |= set(terms(t))
    for i, wanted in of.items():
        rows = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 50 + 50 * n * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def check(spark, frame, rows, items, top=50):
    got = ranked.ranked(frame, spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS), top)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute([(r[0], r[1]) for r in rows], items, top)


ASKED = [(1, "One TWO three, three"), (2, None), (3, ""), (None, "x id"), (4, "élan ÜBER straße kelvin 12"), (5, "under the mit license"), (1, "five"), (6, "absent-term"), (7, "x")]


def test_odd_rows(spark, odd, odd_rows, empty):
    check(spark, odd, odd_rows, ASKED)
    check(spark, odd, odd_rows, ASKED, top=2)
    nothing = spark.createDataFrame([], ITEMS)
    assert ranked.ranked(odd, nothing).count() == 0 == ranked.ranked(empty, spark.createDataFrame([(1, "x", "", 1)], ITEMS)).count()


def test_parts_and_small_stretches_change_nothing(spark, real, real_rows, monkeypatch):
    items = [(k, " ".join((r[1] or "").split()[:9])) for k, r in enumerate(real_rows[:30])]
    monkeypatch.setattr(ranked, "SCAN_BYTES", 5000)
    check(spark, real.repartition(3), real_rows, items)
    monkeypatch.setattr(ranked, "ITEMS", 20)
    check(spark, real, real_rows, items, top=7)


def test_ties_go_to_smaller_ids(spark):
    rows = [(k, "apple pear" if k % 2 else "apple", None, None, 0) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(16)
    check(spark, d, rows, [(1, "pear"), (2, "apple pear")])


def test_top_is_cut_while_rows_arrive():
    import numpy as np

    best, rows = ranked._Best(2, 3), [(k % 2, 1 + (k * 7919) % 13, k) for k in range(500)]
    best.most = 10
    for k in range(0, 500, 25):
        item, score, doc = (np.array(x) for x in zip(*rows[k : k + 25], strict=True))
        best.add(item, score, doc, np.zeros(25, int))
    got = sorted(zip(*(x.tolist() for x in best.cut()[:3]), strict=True))
    want = [r for i in (0, 1) for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[1], r[2]))[:3]]
    assert got == sorted(want)
