"""Distinct documents and owners of a value."""

import hashlib
import time
from itertools import accumulate

from pyspark.sql import functions as F

from tissueflow.llm import secrets

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EXAMPLE, LIVE, TOKEN = "example123", "q8w7e6r5t4", "Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx"


def test_documents_and_owners_are_distinct_and_both_decide(spark):
    most = secrets.MAX_DOCS
    rows = [(k, f"password={EXAMPLE} tok {TOKEN}", None, "hot", 0) for k in range(most + 1)]
    rows += [(100 + k, f"password={LIVE}", None, "one", 0) for k in range(most)]
    rows += [(200, "password=twice123 password=twice123", None, "one", 0)] * (most + 1)  # one document, repeated
    rows += [(None, "password=unnamed1", None, None, 0)] * 2 + [(300, "password=shared12", None, s, 0) for s in ("a", "b")]
    d = spark.createDataFrame(rows, DOCUMENTS)
    count = {r["hash"]: (r["n_docs"], r["n_owners"]) for r in secrets.ownership(secrets.scanned(d)).collect()}
    of = lambda v: count[hashlib.sha256(v.encode()).hexdigest()]
    assert of(EXAMPLE) == of(TOKEN) == (most + 1, 1) and of(LIVE) == (most, 1) and of("twice123") == (1, 1)
    assert of("unnamed1") == (2, 1) and of("shared12") == (2, 2)
    got = [(r["doc_id"], r["n_live"], r["spans"]) for r in secrets.digest(secrets.secrets(d)).collect()]
    for doc, n_live, spans in got:
        if doc is not None and doc <= most:
            assert (n_live, spans) == (0, "assign:0:19")
        elif doc is None or doc < 200:
            assert n_live == 1
        else:
            assert n_live == (2 if doc == 200 else 0)
    assert len(got) == len(rows)


def test_repositories_and_owners_of_other_columns(spark):
    rows = [(k, f"password={EXAMPLE}", f"repo{k % 2}", "alice") for k in range(30)] + [(40 + k, f"password={LIVE}", f"fork{k}", "bob") for k in range(secrets.MAX_DOCS + 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, repo string, who string")
    live = {r["doc_id"]: r["n_live"] for r in secrets.digest(secrets.secrets(d, owner="who", repository="repo")).collect()}
    assert all(live[k] == 1 for k in range(30)) and all(live[40 + k] == 0 for k in range(secrets.MAX_DOCS + 1))


def test_a_hundred_thousand_matches_in_one_text(spark):
    n = 100_000
    text = "".join(f"password=secret{k} " if k % 2 else f"tok{k}Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx " for k in range(n))
    d = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    started = time.monotonic()
    got = secrets.digest(secrets.secrets(d)).first()
    assert time.monotonic() - started < 90
    at, want = 0, []
    for piece in text.split(" ")[:-1]:
        want.append(f"{'assign' if piece.startswith('password') else 'owned'}:{at}:{at + len(piece)}")
        at += len(piece) + 1
    assert got["n_assign"] == n // 2 and got["n_live"] == n // 2 and got["spans"] == ",".join(want)


def test_running_figures(spark):
    for n in (0, 1, 2, 255, 256, 257, 1000):
        values = [(k * 7919) % 101 for k in range(n)]
        d = spark.createDataFrame([(values,)], "v array<int>")
        d = secrets.running(d, "total", F.col("v"), lambda x, y: x + y)
        r = secrets.running(d, "most", F.col("v"), lambda x, y: F.greatest(x, y)).first()
        assert r["total"] == list(accumulate(values)) and r["most"] == list(accumulate(values, max))
