"""Notices in runs of words, whatever the lines."""

import random
import re

import pytest

from tissueflow.llm import licenses

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def wrapped(text, width, lead="\n * "):
    words = text.split()
    return lead.join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


@pytest.mark.parametrize("width", [2, 5])
def test_wrapped_notices_have_labels(spark, width):
    rows = [(k, "a b c d e\n" * (7 * k) + wrapped(t, width) + "\nx y z", "en", "s", 1) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in licenses.licenses(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k][0] and got[k][1] == 1.0


def test_notices_in_their_usual_form(spark):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "en", "s", 1),
        (2, "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License", "en", "s", 1),
        (3, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met", "en", "s", 1),
        (4, "Permission is hereby granted\n" + "far and away\n" * 40 + "free of charge, to any person obtaining a copy", "en", "s", 1),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.licenses(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("gpl", 1.0), 3: ("bsd", 1.0), 4: ("", 0.0)}


@pytest.mark.parametrize("end", [" ", "\n"])
def test_words_far_apart_are_no_notice(spark, end):
    """On one line or on many, scattered words do not add up; the same words together do."""
    gap = end.join(["word"] * 900)
    rows = [(1, end.join(["The film was released", gap, "under", gap, "driving license", gap]), "en", "s", 1), (2, end.join([gap, "released under the MIT license", gap]), "en", "s", 1)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.licenses(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert got == {1: ("", 0.0), 2: ("mit", 1.0)}


def test_runs_against_a_plain_search(spark):
    rng = random.Random(4)
    words = sorted({w for _, t in licenses.TEMPLATES[:8] for w in licenses.template_words(t)})
    texts = []
    for _ in range(60):
        notice = [w for w in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.9]
        for _ in range(rng.randrange(12)):
            notice.insert(rng.randrange(len(notice) + 1), rng.choice(words) if rng.random() < 0.2 else "filler")
        text = ["filler"] * rng.randrange(300) + notice + ["filler"] * rng.randrange(100)
        texts.append("".join(w + rng.choice("  \n") for w in text) + "\n")
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOCUMENTS)
    want = set()
    for k, t in enumerate(texts):
        w, labels, score = re.findall(licenses._WORD, t.lower()), set(), 0.0
        for label, template in licenses.TEMPLATES:
            s, n = set(licenses.template_words(template)), 2 * len(re.findall(licenses._WORD, template))
            best = max(len(s & set(w[a : a + n])) for a in range(len(w))) / len(s)
            if best >= licenses.CONTAINMENT - 1e-9:
                labels.add(label)
                score = max(score, best)
        lower = " ".join(w)
        base = {label for ph, label in licenses.PHRASES.items() if f" {ph} " in f" {lower} "}
        want.add((k, ",".join(sorted(labels | base)), 1.0 if base else round(score, 9)))
    got = {(r["doc_id"], r["labels"], round(r["score"], 9)) for r in licenses.licenses(docs).collect()}
    assert got == want and 10 < sum(bool(x[1]) for x in want) < 60


def test_sql_knows_wrapped_notices(spark, tmp_path):
    """The query's SQL on notices wrapped over lines, changed by some words, between other text."""
    import duckdb

    from tissueflow.llm import oracles, queries

    rng = random.Random(9)
    rows = []
    for k in range(80):
        words = [w for w in rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.93]
        rows.append((k, "Some words of the text.\n" * rng.randrange(4) + wrapped(" ".join(words), rng.randint(2, 9)) + "\nand more of it", "en", "s", 1))
    rows += [(100, None, None, None, 1), (101, "", "en", "s", 1)]
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    q = c.execute(oracles.OP9)
    columns = [d[0] for d in q.description]
    rounded = lambda rows: sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = rounded(map(tuple, queries.op9_licenses(spark, str(tmp_path)).select(*columns).collect()))
    assert got == rounded(q.fetchall()) and sum(r[columns.index("labels")] != "" for r in got) > 40


def test_positional_filter_drops_no_pair_and_some_candidates(spark):
    """Blocks that share a rare word too late are dropped before they are counted; those that reach the threshold never are."""
    template = "alpha beta gamma delta epsilon"
    docs = spark.createDataFrame([(1, "alpha beta gamma delta x"), (2, "delta epsilon alpha y"), (3, "epsilon delta gamma beta alpha")], "doc_id long, text string")
    p = licenses.Prefixes(docs, [("t", template)], 0.8)
    got = {r["key"]: r["score"] for r in licenses.containment_join(docs, [("t", template)]).collect()}
    assert sorted(got.values()) == [0.8, 1.0] and p.least == 4 and len(p.near) == 2
