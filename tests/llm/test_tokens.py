import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tissueflow.llm import token_output
from tissueflow.llm.wavelet import WaveletMatrix

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (7, 3), (1500, 9), (5000, 60000), (3000, 100000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        wm = WaveletMatrix.build(ids, max(1, int(top).bit_length()))
        assert (wm.decode() == ids).all()
        for i in rng.integers(0, n, 20) if n else []:
            s = int(ids[i])
            assert wm.access(int(i)) == s and wm.rank(s, int(i)) == (ids[:i] == s).sum()
            at = np.flatnonzero(ids == s)
            j = random.randrange(len(at))
            assert wm.select(s, j) == at[j] and wm.select(s, len(at)) == -1
        assert wm.rank(top + 1 if top + 1 < 1 << wm.bits else 0, n) == (ids == (top + 1 if top + 1 < 1 << wm.bits else 0)).sum()


def check(frame, rows):
    t, want, start = Tokenizer.from_file(PATH), [], 0
    for d, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_output.token_output(frame, PATH).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_round_trip(odd, odd_rows, real, real_rows, empty):
    check(odd, odd_rows)
    check(real, real_rows)
    assert token_output.token_output(empty, PATH).count() == 0


def test_occurrences(spark, odd, tmp_path):
    path = str(tmp_path / "wm")
    token_output.write(odd, path, PATH, shards=3)
    found = token_output.occurrences(spark, path, token_output.END_ID)
    assert found.count() == odd.count()
    assert found.distinct().count() == odd.count()


def test_another_tokenizer_file_is_encoded_whole(spark, odd_rows, tmp_path):
    """A file whose normalisation or splitting is not the known one must not take the path by words."""
    import json

    import pyarrow as pa

    file = json.loads(open(PATH, encoding="utf-8").read())
    texts = [t or "" for _, t, *_ in odd_rows if len(t or "") < 1000]
    assert token_output.Encoder(PATH).by_part
    changes = {"normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
    for key, value in changes.items():
        other = tmp_path / f"{key}.json"
        other.write_text(json.dumps(file | {key: value}), encoding="utf-8")
        enc, library = token_output.Encoder(str(other)), Tokenizer.from_file(str(other))
        ids, n = enc(pa.array(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert not enc.by_part and ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_words_are_remembered_in_two_generations():
    import pyarrow as pa

    enc, library, rng = token_output.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(3)
    enc.known.most = 50
    texts = [" ".join(rng.choice(["don't", "l'été&'s", "ab12", "x", "'&a", "&&'s", "5's", "w" + str(rng.randint(0, 99))]) for _ in range(30)) + rng.choice(["", " ", "\n"]) for _ in range(40)]
    for part in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        ids, n = enc(part)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def test_small_blocks(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_TOKENS", 7)
    check(odd, odd_rows)


def test_pre_tokens_of_any_simple_text():
    """Short random texts of every kind of character that simple texts hold, against the library."""
    import pyarrow as pa

    enc, library, rng = token_output.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(11)
    letters = ["'", "'", "s", "t", "r", "e", "v", "l", "d", "m", "S", "a", "é", "Ü", "ß", "ÿ", "3", "0", "&", ".", "\x01", "\x7f", " ", " ", "\n", "\t", "\r"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(20000)]
    ids, n = enc(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
