"""The BPE transducer next to the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vetloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "'", "s", "re", "ll", "é", "ü", "漢", "²", "1", "23", "\n", "\t", "\x1c", "\0", "_", "!", "<|endoftext|>", "<|endof",
          "the", "ing", "🙂", "́", "\xa0", "\x85", "　", "\r\n", "  "]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=50).map("".join), st.integers(1, 9))
def test_whole_and_streamed_texts(text, size):
    merges, encoder = bpe.load(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids(encoder.encode(text)) == expected
    assert ids(b"".join(encoder.stream(text[i : i + size] for i in range(0, len(text), size)))) == expected
    decoder = bpe.Decoder(merges)
    decoded = "".join(decoder.feed(expected[i : i + size]) for i in range(0, len(expected), size)) + decoder.feed([], True)
    assert decoded == tokenizer.decode(expected, skip_special_tokens=False) == text


def test_words_longer_than_a_chunk(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    _, encoder = bpe.load(PATH)
    rng = random.Random(1)
    for _ in range(500):
        letters = rng.choice(["abcdefghijklmnopqrstuvwxyz", "ab", "théing", "1234567890", "  \n\t", "=-_.'!", "a1 ", "a", "漢字"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 3000))) + rng.choice(["", "x", " y", "<|endoftext|>z", " 's"])
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids(b"".join(encoder.stream(text[i : i + 50] for i in range(0, len(text), 50)))) == expected


def test_held_bytes_stay_bounded():
    merges, _ = bpe.load(PATH)
    part, most = bpe.Transducer(merges), 0
    for i in range(2000):
        part.feed(b"international" * 5)
        most = max(most, len(part.held))
    assert merges.lookahead < 300 and most < 6 * merges.lookahead


def test_decoder_replaces_what_is_no_text(library):
    merges, _ = bpe.load(PATH)
    rng = random.Random(2)
    for _ in range(300):
        some = [rng.choice([0, 1, 162, 447, 50256, rng.randrange(50257)]) for _ in range(rng.randrange(12))]
        decoder = bpe.Decoder(merges)
        assert "".join(decoder.feed([i]) for i in some) + decoder.feed([], True) == library.decode(some, skip_special_tokens=False)


def test_table(spark, library):
    texts = [None, "", "two  words", "two  words", "<|endoftext|> x", "word " * 40_000, "a" * 150_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, ids string")
    encoded = bpe.encode_table(docs, PATH)
    found = {r.doc: r for r in encoded.collect()}
    for doc, text in [*enumerate(texts), (None, "no id")]:
        expected = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(expected, "<u4").tobytes()
        row = found[doc]
        assert (bytes(row.ids), row.n_tokens, row.ids_sha256) == (packed, len(expected), hashlib.sha256(packed).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert {r.doc: r.text for r in bpe.decode_table(encoded, PATH).collect()} == {**{i: t or "" for i, t in enumerate(texts)}, None: "no id"}
    assert bpe.encode_table(docs.where("false"), PATH).count() == 0
