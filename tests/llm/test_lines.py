"""Operator 12 against a plain count of lines."""

import hashlib
from collections import defaultdict

from tissueflow.llm import lines

LAST = 1 << 63


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    return k if len(k) >= 10 else None


def brute(rows):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(LAST if d is None else d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if key(x) is None or (LAST if d is None else d) == min(held[key(x)])]
        text = "\n".join(left)
        out.append((d, len(every), len(every) - len(left), text, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def check(frame, rows, **more):
    got = lines.without_repeated_lines(frame, **more).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r[0], r[1]) for r in rows])


EXTRA = [
    (20, "Shared line of text\nown line of twenty", None, None, 0),
    (21, "  SHARED line of TEXT\x0b\r\nown line of twenty-one\nshared line of text", None, None, 0),
    (22, "éééééééééé\néééééé\néééééé", None, None, 0),
    (23, "éééééééééé\néééééé\n0123456789\n012345678", None, None, 0),
    (24, "0123456789\n012345678\n\n\n", None, None, 0),
    (25, "\n" * 5000 + "Shared line of text" + "\nz" * 70000, None, None, 0),
    (26, "shared line of text", None, None, 0),
    (26, "shared line of text", None, None, 0),
    (26, "a repeated id with another text\na repeated id with another text", None, None, 0),
    (None, "a repeated id with another text", None, None, 0),
    (-3, "own line of twenty-one", None, None, 0),
]


def test_odd_rows(spark, odd, odd_rows, empty):
    from pyspark.sql import functions as F

    more = spark.createDataFrame(EXTRA, "doc_id long, text string, lang string, source string, n_chars long")
    frame = odd.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit(1) for c in ("id", "key", "h", "h2", "least", "gone", "segment", "suspect", "n")})
    check(frame, odd_rows + EXTRA)
    check(frame.repartition(7), odd_rows + EXTRA, bits=20)  # a filter of one segment
    assert lines.without_repeated_lines(empty).count() == 0


def test_real_rows(real, real_rows):
    check(real, real_rows)


def test_a_full_filter_changes_nothing(real, real_rows, monkeypatch):
    """False positives are confirmed exactly: here every bit of the filter is set."""
    import numpy as np

    monkeypatch.setattr(lines.Suspects, "of", lambda self, digests: lines._halves(digests))
    check(real, real_rows)
    monkeypatch.setattr(lines, "GATHERED", 50)
    h = np.arange(4, dtype="<u8") << np.uint64(40)
    assert [len(b) for b in lines._bits(h, 29)] == [4, 4]


def test_hot_line(spark):
    """A line of every document goes by broadcast and stays in the first."""
    rows = [(k, f"the line of every document\nline {k} of its own\nthe line of pairs {k // 2}", None, None, 0) for k in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8), rows)


def test_filter_holds_every_key_of_two_documents(spark, real):
    """No false negatives: whatever two documents hold is suspected, however the table is split."""
    held = defaultdict(set)
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    for d, t in rows:
        for k in lines.line_keys((t or "").encode()):
            if k:
                held[k].add(d)
    suspects = lines.Suspects(real.select("text").repartition(13))
    twice = [k for k, d in held.items() if len(d) > 1]
    assert len(suspects.of(twice)) == len(twice) > 50
    once = [k for k, d in held.items() if len(d) == 1]
    assert len(suspects.of(once)) < 0.01 * len(once)
