"""Languages of many letters."""

import random

import numpy as np
import pytest

from tissueflow.llm import langid

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written_in(first, letters, seed, docs=60):
    """Texts of 1,500 words over so many letters from a code point on."""
    rng = random.Random(seed)
    words = ["".join(chr(first + rng.randrange(letters)) for _ in range(rng.randint(2, 4))) for _ in range(1500)]
    return [" ".join(rng.choice(words) for _ in range(150)) for _ in range(docs)]


def test_languages_of_many_letters_are_accepted(spark):
    texts = {"en": written_in(0x61, 26, 1), "ko": written_in(0xAC00, 2000, 2), "zh": written_in(0x4E00, 3000, 3)}
    rows = [(1000 * j + k, t, lang, "s", 1) for j, (lang, all_) in enumerate(texts.items()) for k, t in enumerate(all_)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    model = langid.training_text(docs.filter("doc_id % 1000 < 40"))
    p = langid.Parser(model)
    assert set(p.alphabet.letters) == {c for t in model.values() for c in t if c.isalpha()} and len(p.alphabet.letters) > 1000
    held = docs.filter("doc_id % 1000 >= 40")
    assert all(r["lang"] == r["lang_pred"] for r in langid.predicted(held, model).collect())
    assert langid.accepted(held, model).count() == 60


@pytest.mark.parametrize("dense", [1, 4 * 3000, 1 << 26])
def test_sparse_transitions_against_a_plain_parse(dense, monkeypatch):
    monkeypatch.setattr(langid, "DENSE_BYTES", dense)
    rng = random.Random(5)
    make = lambda n, a, b: "".join(rng.choice([chr(0x4E00 + rng.randint(a, b)), " ", "e", "İ"]) for _ in range(n))
    texts = {"aa": make(200, 0, 150), "bb": make(300, 100, 300)}
    docs = [make(80, 0, 310), make(300, 50, 200), texts["aa"][20:90], "Ω", "e"]
    p = langid.Parser(texts)
    codes = np.array([ord(c) for d in docs for c in d])
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    s, at = p.alphabet.symbols(codes, first)
    got = p.phrases(s, at)
    for j, t in enumerate(texts.values()):
        own = p.alphabet.symbols(np.array([ord(c) for c in t]), np.array([0, len(t)]))[0].tolist()
        assert 1 not in own
        have = {tuple(own[a:b]) for a in range(len(own)) for b in range(a + 1, min(len(own), a + 90) + 1)}
        for k in range(len(docs)):
            x, n = s[at[k] : at[k + 1]].tolist(), 0
            for b in range(0, len(x), langid.BLOCK):
                run = ()
                n += 1
                for c in x[b : b + langid.BLOCK]:
                    if (*run, c) in have:
                        run = (*run, c)
                    else:
                        n += 1
                        run = (c,) if (c,) in have else ()
            assert got[k, j] == n
