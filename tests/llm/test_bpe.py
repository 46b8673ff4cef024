import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(bpe.read_ranks(FILE), P.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}, special_tokens={})
ODD = [None, "", " ", "\n\n  x", "it's we'll", "a" * 5000, "é" * 300, "日本語テキスト", "🙂🙃", "\x1c\x1d a\x85b\xa0c", "<|endoftext|>", "Ouea as onsh anst.\nThlyea, erwh", "x\r\n\ty"]


def test_perfect_hash_is_minimal_and_exact():
    t = CODEC.table
    assert sorted(t.key_at) == list(range(len(CODEC.tokens)))
    assert all(t.get(k) == i for i, k in enumerate(CODEC.tokens))
    assert t.get(b"no such token at all") == -1


def test_odd_texts_equal_the_library():
    for text in ODD:
        ids, said = CODEC.encode(text)
        assert ids == LIB.encode_ordinary(text or "")
        assert said == ",".join(map(str, ids))
        assert CODEC.decode(ids) == (text or "").encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=80))
def test_any_text_equals_the_library(text):
    ids, _ = CODEC.encode(text)
    assert ids == LIB.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_query_form(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_documents(docs, FILE, P.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = LIB.encode_ordinary(ODD[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), FILE, P.PATTERN).count() == 0


def test_gaps_and_repeated_keys(tmp_path):
    import base64

    import pytest

    line = lambda t, r: base64.b64encode(t) + b" %d\n" % r
    (tmp_path / "gaps").write_bytes(line(b"a", 0) + line(b"b", 3) + line(b"ab", 5))
    tokens = bpe.read_ranks(str(tmp_path / "gaps"))
    table = bpe.PerfectHash(tokens)
    assert [table.get(t) for t in (b"a", b"b", b"ab", b"", b"c")] == [0, 3, 5, -1, -1] and table.n == 3
    assert bpe.Codec(tokens, r"\S+|\s+").encode("ab")[0] == [5]
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"x", b"y", b"x"])
    (tmp_path / "twice").write_bytes(line(b"a", 0) + line(b"b", 0))
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "twice"))
    (tmp_path / "empty").write_bytes(b"")
    assert bpe.read_ranks(str(tmp_path / "empty")) == []
