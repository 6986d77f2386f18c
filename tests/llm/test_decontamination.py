import random
import re

import numpy as np

from tissueflow.llm import decontamination as dc

from .conftest import DOCUMENTS, REAL

ITEMS = REAL.replace("documents", "benchmark")


def words(t):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def test_search_finds_all_above_threshold():
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(3, 12)))) for k in range(400)]
    index = dc.Index(items)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 30)))
        total = np.zeros(len(index.ids))
        for t in terms:
            total[index.items[t]] += np.array(index.impacts[t])
        for threshold in (0.3, 0.6, 0.9):
            got = sorted(index.search(terms, threshold))
            want = [(i, s) for i, s in enumerate(total) if s >= threshold - 1e-9]
            assert [i for i, _ in got] == [i for i, _ in want]
            assert np.allclose([s for _, s in got], [s for _, s in want])


def test_planted_and_clean(spark, real, real_rows, empty):
    items = spark.read.parquet(ITEMS)
    want = set()
    for i, t in [tuple(r) for r in items.collect()]:
        g = {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}
        for d, text, *_ in real_rows:
            if t in (text or ""):
                want.add((d, i))
            elif g:
                w = words(text)
                assert len(g & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) < 0.5 * len(g), "a case between"
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(real, items).collect()}
    assert got == want and want
    kept = dc.clean(real, items)
    assert kept.columns == real.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in real_rows} - {d for d, _ in want}
    assert dc.leaks(empty, items).count() == 0 and dc.leaks(real, items.limit(0)).count() == 0
    assert dc.clean(real, items.limit(0)).count() == real.count()


def test_item_at_every_place_and_changed_copies(spark, odd):
    rng = random.Random(3)
    word = lambda: f"q{rng.randint(0, 10**5)}"
    question, answer = " ".join(word() for _ in range(30)), " ".join(word() for _ in range(10))
    item = f"{question.capitalize()}? {answer}."
    other = " ".join(word() for _ in range(55))
    rows = [(k, " ".join(word() for _ in range(k * 3)) + " " + item.upper() + " tail " * (k % 5), None, None, None) for k in range(60)]
    rows += [(100, question, None, None, None), (101, answer, None, None, None), (102, "", None, None, None), (103, None, None, None, None), (104, other, None, None, None)]
    rows += [(105, question.replace(" ", " \n", 3) + "; " + answer, None, None, None), (None, item, None, None, None), (None, item, None, None, None)]
    items = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, other), (5, item)], "item_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["item_id"]) for r in dc.leaks(spark.createDataFrame(rows, DOCUMENTS), items).collect())
    assert got == sorted([(k, i) for k in [*range(60), 105, -1, -1] for i in (1, 5)] + [(104, 4)])
    assert dc.leaks(odd, items).count() == 0 and dc.clean(odd, items).count() == odd.count()
