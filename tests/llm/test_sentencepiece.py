"""SentencePiece ids, spans and decoded texts against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from longspan.llm import op11_sentencepiece as op11
from longspan.llm.pieces import PieceModel, fields

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["the ", "  ", " and", "<s>", "</s>", "<0x41>", "▁", "①", "ﬁ", "Ａ", "́", "カﾞ", "㍿", "€", "𐍈", "\x00", "​", "　"]


def written(number: int, value: bytes) -> bytes:
    """A field of a protocol buffer message."""
    out = bytearray()
    for n in (number << 3 | 2, len(value)):
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out) + value


def models() -> dict[str, bytes]:
    """The given model, and ones with the library's own character map and other flags in it."""
    plain = open(PATH, "rb").read()
    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    compiled = written(2, dict(fields(dict(fields(own))[3]))[2])
    return {
        "plain": plain,
        "mapped": plain + written(3, compiled),
        "squeezed": plain + written(3, compiled + bytes([4 << 3, 1])),
        "without prefix": plain + written(3, compiled + bytes([3 << 3, 0])),
    }


@pytest.mark.parametrize("name", ["plain", "mapped", "squeezed", "without prefix"])
def test_ids_spans_and_texts_equal_the_library(name):
    blob, rng = models()[name], random.Random(3)
    library, model = sentencepiece.SentencePieceProcessor(model_proto=blob), PieceModel(blob)
    letters = [*"abcdefghij ABC  \n\t.,éüßñ", *ODD]
    texts = ["", " ", "  ", "a", " a", "a ", "a" * 300, "ab c" * 200]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(600 if k % 20 == 0 else 50))) for k in range(800)]
    for text, (ids, begins, ends) in zip(texts, op11.Encoder(model).encode([t.encode() for t in texts])):
        pieces = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in pieces], repr(text)
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in pieces], repr(text)
        assert model.decoded([*ids.tolist(), 2]).decode() == library.decode([*ids.tolist(), 2])
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 0, 1, 2]) for _ in range(rng.randrange(8))]
        assert model.decoded(ids).decode() == library.decode(ids)


def test_forgetting_changes_nothing(monkeypatch):
    model = op11.read_model(PATH)
    texts = [f"word{k % 40} and others{k}".encode() for k in range(300)]
    whole = op11.Encoder(model).encode(texts)
    monkeypatch.setattr(op11, "KNOWN_BYTES", 2000)
    encoder = op11.Encoder(model)
    for k in range(0, 300, 10):
        for got, want in zip(encoder.encode(texts[k : k + 10]), whole[k : k + 10]):
            assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_unfit_models_are_refused():
    with pytest.raises(ValueError):
        PieceModel(open(PATH, "rb").read() + written(2, bytes([3 << 3, 1])))


def test_query_rows(spark, sf_dir):
    from longspan.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    import hashlib

    rows = QUERIES["op11_sentencepiece"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = [*library.encode(docs[r.doc_id]), 2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_messy_rows(spark, messy, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = op11.encode(messy, PATH)
    own = sorted((r.doc_id or 0, r.text or "") for r in messy.collect())
    rows = sorted(found.collect(), key=lambda r: (r.doc_id or 0, r.decoded))
    assert sorted((r.doc_id or 0) for r in rows) == [d for d, _ in own]
    texts = {(r.doc_id or 0, r.decoded): r for r in rows}
    for doc, text in own:
        ids = [*library.encode(text), 2]
        r = texts[doc, library.decode(ids)]
        assert r.ids == ids and r.ends[-1] == r.begins[-1] == len(text.encode())
        assert r.spans_crc32 == zlib.crc32(np.array(r.begins + r.ends, "<i4").tobytes())
        raw = text.encode()
        # Every byte belongs to one piece, in order.
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends)) == raw
    assert [(r.ids, r.decoded) for r in rows if r.doc_id == 2] == [([2], "")]
    assert op11.encode(nothing, PATH).isEmpty()
    again = op11.decode(found, PATH)
    assert sorted((r.doc_id or 0, r.text) for r in again.collect()) == [(r.doc_id or 0, r.decoded) for r in rows]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [2])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in op11.decode(odd, PATH).collect()} == {1: None, 2: "", 3: ""}


def test_bytes_that_are_no_utf8(spark):
    docs = spark.createDataFrame([(1, b"ab\xff c\xe2\x82")], "doc_id bigint, text binary")
    row = op11.encode(docs, PATH).first()
    assert row.decoded == "ab� c��" and row.ends[-1] == 7
