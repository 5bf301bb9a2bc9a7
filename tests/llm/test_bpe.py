"""BPE against the tiktoken library."""

import hashlib
import random

import pytest
import regex
import tiktoken

from tessella.llm import bpe, catalog

P = pytest.importorskip("public_tokenizers")
PIECES = ["'", "'s", "'re", "'LL", "s", "t", "ll", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "a", "B", "é", "1", "²", "中", "!", "_", "\U0001f600", "x" * 40, "the", " "]


@pytest.fixture(scope="module")
def own():
    assert P.PATTERN == bpe.PATTERN
    return bpe.encoder(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_random_texts(own, other):
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 14)))
        ids = own.encode(text)
        assert ids.tolist() == other.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()
        at = bpe.cut_points(text, own.classes).tolist()
        assert [text[a:b] for a, b in zip(at, at[1:])] == regex.findall(P.PATTERN, text)


def test_long_pre_tokens(own, other):
    rng = random.Random(2)
    for text in ("a" * 30_000, "".join(rng.choices("abcdefgh", k=30_000)), " " * 20_000, "=" * 20_001):
        assert own.encode(text).tolist() == other.encode_ordinary(text)


def test_memory_is_bounded_and_does_not_matter(own, other):
    small = bpe.Encoder(own.ranks, memory=3)
    text = "one two three four five one two three four five " * 3
    assert small.encode(text).tolist() == other.encode_ordinary(text) and len(small) <= 3


def test_other_pattern_and_very_long_text(own, other, monkeypatch):
    plain = bpe.Encoder(own.ranks, pattern=r"\S+|\s+")
    want = tiktoken.Encoding("p", pat_str=r"\S+|\s+", mergeable_ranks=own.ranks, special_tokens={})
    assert plain.encode("some text  here's\n more").tolist() == want.encode_ordinary("some text  here's\n more")
    monkeypatch.setattr(bpe, "LONG", 10)
    assert own.encode("some longer text  here's\n more").tolist() == other.encode_ordinary("some longer text  here's\n more")


def test_documents(spark, docs, no_docs, other):
    path = P.path("byte_bpe_50k.tiktoken")
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, path).collect()), key=repr)
    want = sorted(((r.doc_id, other.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=repr)
    assert got == want
    assert bpe.encode(no_docs, path).count() == 0


def test_op6(spark, other):
    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = other.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.op6_bpe(spark, sf).collect()} == want
