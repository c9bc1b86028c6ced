"""Cuts between letters and signs, and the search with its tables full, against the library."""

import random

import pytest

from gridframe.llm import pieces

SIGNS = [".", ",", "!!", "...", "$$$", "%%%", "?!", "'s", "n't", "²", "².", "²,", ");", "=", "_", "é.", "ß,", ".%%%", "\n", "日。"]


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path())


def texts(n):
    rng = random.Random(11)
    return ["".join(rng.choices("aeinrstmglhö", k=rng.randint(1, 14))) + "".join(rng.choices(SIGNS, k=rng.randint(1, 3))) + rng.choice(["", " more", "x", " a.b"]) for _ in range(n)]


def test_signs_are_cut_from_letters():
    """A word is looked up alone, whatever signs follow it; a piece that holds a letter and a sign stays whole."""
    model = pieces.model(pieces.piece_path())
    assert model.stretches("▁word.▁word,\n▁word.%%%") == ["▁word", ".", "▁word", ",", "\n", "▁word", ".%%%"]
    assert not [p for p in model.pieces if len(model.stretches(p)) != 1]
    assert "²." in model.pieces and "".join(model.stretches("m².")) == "m²." and "." not in model.stretches("m².")


@pytest.mark.parametrize("places", [4, pieces.MAX_PLACES])
def test_ids_beside_signs(library, monkeypatch, places):
    monkeypatch.setattr(pieces, "MAX_PLACES", places)
    monkeypatch.setattr(pieces, "MAX_STRETCHES", 8 * places)
    monkeypatch.setattr(pieces, "KEPT_STRETCHES", places)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 8 * places)
    model = pieces.open_model(pieces.piece_path())
    for text in texts(1500):
        ids = model.encode(model.normal(text))
        assert memoryview(ids).cast("H").tolist() == library.encode(text), text
    assert len(model.known) <= places + 1
