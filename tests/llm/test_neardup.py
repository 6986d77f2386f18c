import random
import re

import numpy as np

from tissueflow.llm import graphs, neardup

from .conftest import DOCUMENTS


def brute(rows, size, percent):
    sets = []
    for d, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append(s)
    n = len(rows)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for v in where.values() if len(v) < 400 for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        if rows[a][0] is None or rows[b][0] is None:
            continue
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            label[find(a)] = find(b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((-1, len(sets[i]), -1, True) if rows[i][0] is None else (rows[i][0], len(sets[i]), least[find(i)], rows[i][0] == least[find(i)])) for i in range(n))


def check(frame, rows, size=3, percent=85):
    got = sorted(tuple(-1 if v is None else v for v in (r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in neardup.near_duplicates(frame, size, percent).collect())
    want = brute(rows, size, percent)
    assert got == want
    return sum(not r[3] for r in want)


def test_real(real, real_rows):
    assert check(real, real_rows) > 30
    assert check(real, real_rows, 5, 80) > 30


def test_odd(odd, odd_rows, empty):
    rows = [r for r in odd_rows if r[0] not in (4, 5)]
    check(odd.filter("doc_id is null or doc_id not in (4, 5)"), rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(odd, 3, 85).collect()}
    assert got[3] == got[4] == got[5] == 3
    assert neardup.near_duplicates(empty).count() == 0


def test_chain_of_near_copies(spark):
    """A large family in which most pairs are below the threshold, over several blocks."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows, now = [], base
    for k in range(700):
        now = list(base if rng.random() < 0.5 else now)
        for _ in range(rng.randint(0, 4)):
            now[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(now), None, None, None))
    rows += [rows[0]] * 40
    d = spark.createDataFrame(rows, DOCUMENTS)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(148)} for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                label[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows)))
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(d, 3, 85).collect())
    assert got == want


def test_one_document_of_each_group_stays(real):
    out = neardup.deduplicated(real)
    kept = {r["doc_id"] for r in neardup.near_duplicates(real).filter("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept and out.columns == real.columns


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(1)
    a, b = (np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3000, 1000))
    both = np.sort(np.concatenate([a, b]))
    values, first = np.concatenate([a, b, both]), np.array([0, 3000, 4000, 8000])
    k = neardup.sketch(values, first).astype(int)
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    same, more = (k[0] == k[2]).sum(), (k[0] > k[2]).sum()
    guess = neardup.likeliest(np.array([same]), np.array([more]), np.array([280 - same - more]), np.array([3000.0]), np.array([4000.0]))
    assert abs(guess[0] - 0.75) < 0.12


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400 + k, 401 + k) for k in range(60)] + [(900, 1000 + k) for k in range(50)]
    label = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: x for v, x in label.items() if any(a != b and v in (a, b) for a, b in edges)}


def test_words_that_polynomials_confuse(spark):
    """Two texts alike but for a word and its Thue-Morse complement: 20 of 26 shingles are shared, not all."""
    word = lambda letters: "".join(letters[k.bit_count() & 1] for k in range(2048))
    shared = [f"w{k}" for k in range(24)]
    rows = [(k, " ".join([*shared[:12], word(letters), *shared[12:]]), None, None, None) for k, letters in enumerate(("ab", "ba"))]
    check(spark.createDataFrame(rows, DOCUMENTS), rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCUMENTS), size=3, percent=85).collect()
    assert sorted(r["component_id"] for r in got) == [0, 1]


def family(n, own, seed=0):
    """Texts of 200 shared words, cut at some place by own words of each: near the threshold and below it, so none are linked."""
    rng = random.Random(seed)
    shared = [f"s{k}" for k in range(200)]
    rows = []
    for d in range(n):
        at = rng.randrange(190)
        rows.append((d, " ".join([*shared[:at], *[f"d{d}w{k}" for k in range(own)], *shared[at:]]), None, None, None))
    return rows


def meeting(a, b):
    """Keys of two sets that make them partners."""
    sides = dict(zip(b[0].tolist(), b[1].tolist(), strict=True))
    return sum(k in sides and (s == 0 or s != sides[k]) for k, s in zip(a[0].tolist(), a[1].tolist(), strict=True))


def test_prefix_keys_meet_for_every_pair_at_the_threshold():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        for trial in range(400):
            n = int(rng.integers(1, 90)) if trial % 2 else int(rng.integers(100, 900))
            base = np.unique(rng.integers(0, 1 << 63, n + 300).astype(np.uint64) * np.uint64(2))
            x = base[:n]
            keep = x[rng.random(n) < rng.uniform(0.75, 1)]
            y = np.unique(np.concatenate([keep, base[n : n + int(rng.integers(0, 1 + n // 4))]]))
            if not len(y):
                continue
            both = len(np.intersect1d(x, y))
            counters = np.full(1 << neardup.COUNTERS, 2)
            counters[rng.integers(0, len(counters), 1 << 19)] = 9
            if 100 * both >= percent * (len(x) + len(y) - both):
                assert meeting(*(neardup.prefix_keys(v, counters, percent) for v in (x, y))), (percent, len(x), len(y), both)


def test_family_below_the_threshold(spark):
    """No links, and no pairs to compare either: the members share no prefix key."""
    rows = family(600, 36)
    d = spark.createDataFrame(rows, DOCUMENTS)
    got = neardup.near_duplicates(d, size=3, percent=85).collect()
    assert len(got) == 600 and all(r["component_id"] == r["doc_id"] for r in got)
    sets = [neardup.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 3)[0] for _, t, *_ in rows[:200]]
    counters = sum(np.bincount((x >> np.uint64(64 - neardup.COUNTERS)).astype(int), minlength=1 << neardup.COUNTERS) for x in sets)
    keys = [neardup.prefix_keys(x, counters, 85) for x in sets]
    pairs = sum(meeting(keys[0], k) > 0 for k in keys[1:])
    assert pairs < 20, pairs


def test_family_around_the_threshold(spark):
    """Texts of one base with own words at random places: some pairs are linked, against all pairs."""
    rng = random.Random(3)
    rows = []
    for d in range(150):
        w = [f"s{k}" for k in range(120)]
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(w), None, None, None))
    check(spark.createDataFrame(rows, DOCUMENTS), rows)
