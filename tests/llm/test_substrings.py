import hashlib
import random
import re

from tissueflow.llm import substrings

from .conftest import DOCUMENTS


def brute(rows, window):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    last = float("inf")
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, last), last if d is None else d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (last if d is None else d):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def check(frame, rows, window):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.without_repeats(frame, window).collect())
    want = brute(rows, window)
    assert got == want
    return sum(r[2] for r in want)


def test_real(real, real_rows):
    assert check(real, real_rows, 50) > 1000


def test_odd(odd, odd_rows, empty):
    check(odd, odd_rows, 50)
    assert substrings.without_repeats(empty).count() == 0


def test_borders(spark):
    """Overlaps of all lengths around the window at all alignments, ties and repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abÉ.") for _ in range(rng.randint(1, 6)))
    pool = [word() for _ in range(400)]
    rows = []
    for k in range(150):
        w = [word() + str(rng.randint(0, 9999)) for _ in range(rng.randint(0, 60))]
        a = rng.randint(0, 330)
        w[rng.randint(0, len(w)) :] = pool[a : a + rng.randint(15, 70)]
        rows.append((k // 2 if k % 7 == 0 else k, rng.choice([" ", "\n", "\t "]).join(w), None, None, None))
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None)]
    d = spark.createDataFrame(rows, DOCUMENTS)
    for window in (20, 32, 50):
        assert check(d, rows, window) > 0


def thue_morse(n, letters):
    return "".join(letters[k.bit_count() & 1] for k in range(n))


def test_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement: equal under any polynomial modulo 2 ** 64, so a hash must not be one."""
    shared = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([thue_morse(2048, letters), *shared]), None, None, None) for k, letters in enumerate(("ab", "ba"))]
    rows += [(k + 10, " ".join([*shared[:20], thue_morse(4096, letters), *shared[20:]]), None, None, None) for k, letters in enumerate(("ab", "ba", "ab"))]
    d = spark.createDataFrame(rows, DOCUMENTS)
    assert check(d, rows, 50) > 60


def test_word_hashes_tell_words_apart():
    import numpy as np

    from tissueflow.llm.common import WORD_SEPARATORS, Words, separators

    rng = random.Random(1)
    words = {thue_morse(n, x) for n in (1, 8, 9, 64, 2048, 8192) for x in ("ab", "ba")} | {"a" * n for n in range(1, 300)} | {"x" * n + "y" for n in range(300)} | {"a\0", "a\0\0", "\0", "\0\0"}
    words |= {"".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(20000)}
    words = sorted(words)
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    sep = separators(WORD_SEPARATORS)
    for seed in (2, 22):
        h = Words(raw, np.array([0, len(raw)]), sep).hashes(seed)
        assert len(set(h.tolist())) == len(words) == len(h)
        alone = [Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), sep).hashes(seed)[0] for w in words[::500]]
        assert alone == h[::500].tolist()  # whatever stands around a word
    up = Words(np.frombuffer(b"Ab AB \xc3\x89 \xc3\xa9", np.uint8), np.array([0, 11]), sep).hashes(3, lower=True).tolist()
    assert up[0] == up[1] and up[2] != up[3]
