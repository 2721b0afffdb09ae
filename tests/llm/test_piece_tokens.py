from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from factorloom.llm import piece_tokens as P

ALPHABET = ["a", "the", " ", "  ", "   ", "\n", "\r\n", "▁", "é", "日", "\U0001f600", "\x00", "\t", "</s>", "<0x0A>", "//", "/**", "==", "ing", " " * 20, "0", "12", ".", " "]


@pytest.fixture(scope="module")
def both():
    proto = P._model(P.public_model())
    return P.PieceTokens(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)


def test_encoding_and_its_decoding_are_the_library_s(both):
    mine, library, r = *both, random.Random(1)
    for _ in range(4000):
        text = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25)))
        ids = library.encode(text)
        assert mine.encode_text(text) == (",".join(map(str, ids)), library.decode(ids)), repr(text)


def test_decoding_of_any_ids(both):
    mine, library, r = *both, random.Random(2)
    for _ in range(4000):
        ids = [r.choice([r.randrange(32000), r.randrange(260)]) for _ in range(r.randint(0, 8))]
        assert mine.decode(ids) == library.decode(ids), ids


def test_odd_rows(both, odd, none):
    library, model = both[1], P.public_model()
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "")
        want.append((repr(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((repr(r[0]), *r[1:]) for r in P.round_trip(odd, model).collect()) == sorted(want)
    back = P.decode(P.encode(odd, model), model)
    assert sorted(repr((r["doc_id"], r["text"])) for r in back.collect()) == sorted(repr((r["doc_id"], library.decode(library.encode(r["text"] or "")))) for r in odd.collect())
    assert P.round_trip(none, model).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):
        P.PieceTokens(b"not a model")
