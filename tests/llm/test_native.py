import hashlib
import re
from collections import defaultdict

from tissueflow.llm import licenses, mixing, secrets


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer("((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def check_secrets(frame, rows):
    got = sorted((r["doc_id"] or -1, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.digest(secrets.secrets(frame)).collect())
    want = []
    for d, t, *_ in rows:
        s = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        want.append((d or -1, *[sum(x[1] == k for x in s) for k in range(3)], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_secrets(odd, odd_rows, real, real_rows, empty):
    check_secrets(odd, odd_rows)
    check_secrets(real, real_rows)
    assert secrets.digest(secrets.secrets(empty)).count() == 0


def test_ownership_separates_examples_from_live_values(spark):
    example, live, tail = "password=example123", "password=q8w7e6r5t4", " tok Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zx"
    rows = [(k, example, None, f"o{k}", 0) for k in range(5)] + [(7, live, None, "o1", 0), (8, live + tail, None, "o1", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["n_live"], r["spans"]) for r in secrets.digest(secrets.secrets(d)).collect()}
    assert [got[k][0] for k in range(5)] == [0] * 5 and got[7] == (1, "assign:0:19")
    assert got[8] == (1, "assign:0:19,owned:24:56")


def check_licenses(frame, rows):
    got = sorted(tuple(-1 if v is None else v for v in (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in licenses.licenses(frame).collect())
    want = []
    for d, t, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at, labels = [], set()
        for ph, label in licenses.PHRASES.items():
            p = ph.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append((-1 if d is None else d, len(w), len(at), min(at, default=-1), max(at, default=-1), ",".join(sorted(labels))))
    assert got == sorted(want)


def test_license_places(odd, odd_rows, real, real_rows, empty):
    check_licenses(odd, odd_rows)
    check_licenses(real, real_rows)
    assert licenses.licenses(empty).count() == 0


def test_containment_join_finds_every_run(real, real_rows, odd):
    found = {(r["key"], r["label"], round(r["score"], 9)) for r in licenses.containment_join(real).collect()}
    keys = {r["doc_id"]: r["key"] for r in real.select("doc_id", licenses._key().alias("key")).collect()}
    want = {}
    for d, t, *_ in real_rows:
        w = re.findall(licenses._WORD, (t or "").lower())
        for label, text in licenses.TEMPLATES:
            s, n = set(licenses.template_words(text)), 2 * len(re.findall(licenses._WORD, text))
            if len(s & set(w)) >= licenses.CONTAINMENT * len(s) - 1e-9:
                share = max(len(s & set(w[a : a + n])) for a in range(len(w))) / len(s)
                if share >= licenses.CONTAINMENT - 1e-9:
                    want[keys[d], label] = max(round(share, 9), want.get((keys[d], label), 0))
    assert found == {(*k, v) for k, v in want.items()} and want
    labels = {r["doc_id"]: r["labels"] for r in licenses.licenses(odd).collect()}
    assert labels[10] == "gpl-3,mit"


def want_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(frame, rows):
    got = mixing.mixed(frame).collect()
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] += n
        biggest[s] = max(biggest[s], n)
    want = want_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1
    return {(r["doc_id"], r["text"], r["taken"]) for r in got}


def test_mixing(odd, odd_rows, real, real_rows, empty):
    check_mix(odd.filter("doc_id is null or doc_id not in (4)"), [r for r in odd_rows if r[0] != 4])
    once = check_mix(real, real_rows)
    assert once == check_mix(real.repartition(5), real_rows)
    assert mixing.mixed(empty).count() == 0
    assert mixing.repeated(real).count() == sum(r["times"] for r in mixing.mixed(real).collect())
