"""The agenda and the decoder against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tallyhouse.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a ", " a", "  a  b ", "▁", "▁a ▁", "▁ ▁x", "a\x00b", "<s> </s> <unk> <0x41>", "ﬁ é é 😀",
    "﻿x ", "x" * 3000, "é" * 2000, " " * 700, "a  " * 200, "w " * 70_000, "\n\n a\t b  \n", "１２ 12",
    "Zeile eins\nZeile zwei, 3.14 – ñandú", "q" * 70_000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture
def docs(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame(
            [(i, t, None, None) for i, t in zip(ids, texts)], "doc_id long, text string, doc string, ids string"
        )

    return make


def random_texts(n):
    draw = random.Random(5)
    return ["".join(draw.choice(" ▁ab\né漢😀0theing, ") for _ in range(draw.randint(0, 60))) for _ in range(n)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_round_trip_equals_the_library(docs, library):
    texts = [*ODD, *random_texts(800)]
    found = {r.doc: r for r in pieces.digests(docs(texts), PATH).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == sha(b"".join(x.to_bytes(4, "little") for x in ids)), repr(text)[:60]
        assert found[i].decoded_sha256 == sha(library.decode(ids).encode()), repr(text)[:60]


def test_encode_and_decode_as_tables(docs, library):
    texts = [*ODD, "same", "same"]
    encoded = pieces.encode(docs(texts, [*range(len(ODD)), None, None]), PATH)
    ids = encoded.collect()
    assert sum(r.doc is None for r in ids) == 2
    assert all(r.ids == library.encode(ODD[r.doc] or "", add_bos=True, add_eos=True) for r in ids if r.doc is not None)
    decoded = {r.doc: r.text for r in pieces.decode(encoded, PATH).collect() if r.doc is not None}
    assert all(decoded[r.doc] == library.decode(r.ids) for r in ids if r.doc is not None)


def test_decoder_is_incremental(library):
    machine = pieces.Decoder(pieces.codec(PATH).vocabulary)
    ids = library.encode("a 😀\U0001f9ff b")
    assert "".join(machine.feed([i]) for i in ids) + machine.finish() == "a 😀\U0001f9ff b"
    broken = [next(i for i, b in machine.vocabulary.bytes.items() if b == x) for x in (0xF0, 0x9F)]
    machine.reset()
    assert machine.feed(broken) == "" and machine.finish() == library.decode(broken)


def test_a_wrong_agenda_fails_the_check(monkeypatch):
    machine = pieces.Codec(PATH)
    monkeypatch.setattr(pieces.Vocabulary, "merge", lambda self, section: [3])
    with pytest.raises(ValueError, match="differs"):
        machine.prepare(["some text"])


def test_memo_is_bounded(monkeypatch, library):
    machine = pieces.Codec(PATH)
    monkeypatch.setattr(pieces, "MEMO", 10)
    for text in random_texts(50):
        machine.prepare([text])
        assert machine.encode(text) == library.encode(text, add_bos=True, add_eos=True)


def test_no_rows(docs):
    assert pieces.digests(docs([]), PATH).collect() == []
    assert pieces.decode(pieces.encode(docs([]), PATH), PATH).collect() == []
