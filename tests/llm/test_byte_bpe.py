"""Byte-level BPE against the tiktoken library, and the round trip of decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import byte_bpe, queries

ODD = sorted(byte_bpe._odd_characters())
LETTERS = [*"aAb  \n\t\x0b\x1c\x85\xa0 　'sréİĳ́Σ.,-ςÉ12<>!?#ü日本\x00᠎’▁Āſǿ", "'ll", "<|endoftext|>", "<unk>", *ODD[::900]]


@pytest.fixture(scope="module")
def model():
    return byte_bpe.byte_bpe(byte_bpe.ranks_path(), most_words=300)  # the table begins anew many times


@pytest.fixture(scope="module")
def library(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})


def test_ids_equal_the_library(model, library, small_docs):
    rng = random.Random(3)
    texts = [None, "", *small_docs["text"]]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for k in range(0, len(texts), 97):
        for text, ids in zip(texts[k : k + 97], model.encode_all(texts[k : k + 97]), strict=True):
            assert ids.tolist() == library.encode_ordinary(text or ""), text
            assert model.decode(ids)[0].tobytes() == (text or "").encode()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(model, library, text):
    assert model.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 100_000, " " * 20_000 + "a", "\n \n" * 999, "ü" * 3000])
def test_very_long_matches(model, library, text):
    assert model.encode(text).tolist() == library.encode_ordinary(text)


def test_every_token_is_reached_by_merges(model):
    """The serialised model alone gives each token back, so ids do not hang on the look-up of whole matches."""
    tokens = sorted(model.ranks, key=model.ranks.get)
    got = model._sp.encode([byte_bpe.piece_of(t) for t in tokens], out_type=int)
    assert got == [[k] for k in range(len(tokens))]
    assert [byte_bpe.bytes_of(byte_bpe.piece_of(t)) for t in tokens] == tokens


def test_gaps_in_the_ranks(tmp_path):
    """Ids are the file's ranks, not places in the model."""
    ranks = {bytes([b]): 10 + 2 * b for b in range(256)} | {b"ab": 900, b"abc": 950, b"bc": 920}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(b"%s %d\n" % (byte_bpe.base64.b64encode(t), r) for t, r in ranks.items()))
    own = byte_bpe.byte_bpe(str(path))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "bcabcc ab", "xabbc"):
        assert own.encode(text).tolist() == want.encode_ordinary(text)
        assert own.decode(own.encode(text))[0].tobytes() == text.encode()
    for bad in ([11], [-1], [5000]):
        with pytest.raises(ValueError):
            own.decode(np.array(bad))


def test_query_over_odd_rows(spark, library, odd_docs, odd_rows, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_byte_level_bpe"](spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table_and_null_lists(spark, no_docs):
    path = byte_bpe.ranks_path()
    assert byte_bpe.digests(byte_bpe.decoded(byte_bpe.encoded(no_docs, path), path)).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in byte_bpe.decoded(rows, path).collect()} == {1: None, 2: b"", 3: b"ab"}
