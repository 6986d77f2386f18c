import zlib

import numpy as np
from pyspark.sql import functions as F

from tissueflow.llm import langid, toxicity

SF = "/root/testdata/sf0.1"


def test_automaton_accepts_exactly_the_substrings():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 3, 60)
    table = langid.automaton(s, 3)
    have = {tuple(s[a:b]) for a in range(60) for b in range(a, 61)}
    for _ in range(3000):
        x = rng.integers(0, 3, rng.integers(1, 8))
        state = 0
        for c in x:
            state = table[state, c]
            if state < 0:
                break
        assert (state >= 0) == (tuple(x) in have)


def test_phrases_against_a_plain_parse():
    texts = {"aa": "the cat sat on the mat and the hat", "bb": "le chat est sur la natte et le chapeau"}
    p = langid.Parser(texts)
    docs = ["the hat sat", "le chat", "zzz the", "q", "cat " * 200]
    codes = np.array([ord(c) for d in docs for c in d])
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    s, at = p.alphabet.symbols(codes, first)
    got = p.phrases(s, at)
    for k, d in enumerate(docs):
        x = s[at[k] : at[k + 1]].tolist()
        for j, t in enumerate(texts.values()):
            own, _ = p.alphabet.symbols(np.array([ord(c) for c in t]), np.array([0, len(t)]))
            own, n = own.tolist(), 0
            for b in range(0, len(x), langid.BLOCK):
                part, i = x[b : b + langid.BLOCK], 0
                n += 1
                run: list = []
                for c in part:
                    if any(own[z : z + len(run) + 1] == [*run, c] for z in range(len(own) - len(run))):
                        run.append(c)
                    else:
                        n += 1
                        run = [c] if c in own else []
            assert got[k, j] == n


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = langid.training_text(docs.filter(~langid.held_out(F.col("doc_id"), 4, 2)))
    out = langid.predicted(docs, texts)
    held = out.filter(langid.held_out(F.col("doc_id"), 4, 2)).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.98
    assert sum(zlib.crc32(str(k).encode()) % 4 == 2 for k in range(100)) == spark.range(100).filter(langid.held_out(F.col("id"), 4, 2)).count()
    got = {r["doc_id"]: r for r in langid.predicted(odd, texts).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 11))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["lang_pred"] == got[5]["lang_pred"] != "und"
    assert langid.predicted(empty, texts).count() == 0 and langid.accepted(odd, texts).columns == odd.columns
    assert {r["lang_pred"] for r in langid.predicted(odd, langid.training_text(empty)).collect()} == {"und"}
    assert langid.training_text(docs) == langid.training_text(docs.repartition(7))


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(toxicity.sample(docs, labels.filter(~held)))
    out = toxicity.scored(docs, model).join(labels, "doc_id").filter(langid.held_out(F.col("doc_id"), 3, 1))
    r = out.agg(F.sum(F.expr("int(score >= 0.7 and toxic = 1)")).alias("tp"), F.sum("toxic").alias("p"), F.sum(F.expr("int(score >= 0.7 and toxic = 0)")).alias("fp"), F.count("*").alias("n")).first()
    assert r["tp"] / r["p"] > 0.8 and r["fp"] / (r["n"] - r["p"]) < 0.02
    text = "All is well here. You are a stupid idiot and a moron. Good day"
    d = spark.createDataFrame([(1, text), (2, text), (3, "É " + text)], "doc_id long, text string")
    got = toxicity.scored(d, model).orderBy("doc_id").collect()
    assert got[0]["score"] == got[1]["score"] > 0.7 and len(got[0]["offending"]) == 1
    span = got[2]["offending"][0]
    assert ("É " + text)[span["start"] : span["end"]] == "You are a stupid idiot and a moron"
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(odd, model).collect()}
    assert scores[1] == scores[2] == scores[11] == 0 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.scored(empty, model).count() == 0
    nothing = toxicity.toxicity(odd, labels.limit(0))
    assert nothing.filter("score <> 0").count() == 0


def test_noisy_or_learns_sentences():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(400):
        toxic = k % 4 == 0
        bags = [(s, int(f)) for s in range(5) for f in rng.integers(100, 160, 6)]
        if toxic:
            bags.append((int(rng.integers(0, 5)), 7))
        rows.append({"toxic": int(toxic), "features": np.array(sorted(set(bags)), dtype=np.int32).tobytes()})
    weights, bias = toxicity.train(rows)
    assert weights[7] + bias > 0 > max(weights[100:160]) + bias
