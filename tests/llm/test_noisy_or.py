"""Operator 6 recomputed in plain Python."""

import math
import random
import re

import numpy as np

from tissueflow.llm import toxicity

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def features(word, base):
    """The word's own feature and those of its starts."""
    value = lambda b: mix((ord(chr(b).lower()) if b < 128 else b) + 1 + 6000 & M)
    own = lambda part: sum(value(b) * pow(base, k, 1 << 64) for k, b in enumerate(part)) & M
    out = [mix(own(word)) >> 44]
    return out + [mix(own(word[:n]) + k & M) >> 44 for k, n in enumerate((4, 5, 6), 1) if len(word) > n]


def plain(text, weights, bias, base):
    clean, bad = 1.0, []
    for m in re.finditer(rb"[^.!?\n]+", text.encode()):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", m[0])
        z = sum(float(weights[f]) for w in words for f in features(w, base))
        if z > 0:
            p = 1 / (1 + math.exp(-max(-30, min(30, z + bias))))
            clean *= 1 - min(p, 1 - 1e-12)
            if p >= toxicity.OFFENDING:
                bad.append(b" ".join(words).decode())
    return 1 - clean, bad


def test_scores_against_a_plain_noisy_or(spark, real, real_rows):
    base = int(toxicity._R)
    rng = np.random.default_rng(3)
    weights = np.where(rng.random(1 << toxicity.BITS) < 0.05, rng.random(1 << toxicity.BITS) * 4, 0).astype(np.float32)
    rows = real_rows[:150] + [(9001, None), (9002, ""), (9003, "...\n!"), (9004, "É. é"), (9005, "Word " * 3000 + ". Other word!")]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(d, (weights, -6.0)).collect()}
    some = 0
    for doc, text in (r[:2] for r in rows):
        score, bad = plain(text or "", weights, -6.0, base)
        assert abs(got[doc]["score"] - score) < 1e-9
        spans = [" ".join(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text[s["start"] : s["end"]])) for s in got[doc]["offending"]]
        assert spans == bad
        some += bool(bad)
    assert some > 20


def test_packed_features_come_back():
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(4096), rng.randrange(1 << toxicity.BITS)) for _ in range(500)})
    packed = np.array([s << toxicity.BITS | f for s, f in pairs], dtype=np.uint32).tobytes()
    assert np.frombuffer(toxicity._unpacked(packed), dtype=np.int32).reshape(-1, 2).tolist() == [list(p) for p in pairs]


def test_sampled_texts_are_bounded(spark):
    """The longest sampled text, all short words or all sentences, stays within the stated bound."""
    for text in ("abcdefg " * 1024, "a." * 4096, "ab " * 2730):
        assert len(text) <= toxicity.SAMPLE_BYTES
        (r,) = toxicity._rows(spark.createDataFrame([(1, text)], "toxic int, text string")).collect()
        assert len(r["features"]) <= 4 * 4096
