"""A unigram vocabulary from a public SentencePiece file, and texts as stretches of it.

The public file's pieces are merges in order of rank, without probabilities. As a unigram model
piece number r (from 1, in the file's order) has the score ``-log(r + 1)``, as by Zipf's law, in
whole 1/16ths: sums of such numbers are exact, also in the library's 32-bit floats, as long as
they stay under a million. ``library_model`` writes the same model for the SentencePiece library.

The text is one space and then the text, with spaces as U+2581; other characters stay. No piece
has a character before a U+2581 that is not one itself, or holds an ASCII letter beside another
ASCII character, or a line end. So lattices fall apart at such places (``load`` checks it). A character that no piece
stands for costs the least score less 10 and counts as its UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

UNIT = 16  # parts of a score
UNKNOWN_PENALTY = 10 * UNIT
SPACE = "▁"
NORMAL, BYTE = 1, 6
_APART = re.compile(r"[A-Za-z][!-@\[-`{-~]|[!-@\[-`{-~][A-Za-z]")
_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_OTHER[[c for c in range(33, 127) if not chr(c).isalpha()]] = True


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, int]   # normal piece -> id
    scores: np.ndarray       # by id, in 1 / UNIT
    texts: list[bytes]       # by id; of a byte piece its byte
    byte_ids: list[int]      # by byte
    unknown: int             # score of an unknown character, in 1 / UNIT


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as raw:
        model.ParseFromString(raw.read())
    return model


def zipf_scores(model) -> list[int]:
    rank, scores = 0, []
    for piece in model.pieces:
        rank += piece.type == NORMAL
        scores.append(-round(UNIT * math.log(rank + 1)) if piece.type == NORMAL else 0)
    return scores


def load(path: str) -> Vocabulary:
    model = _proto(path)
    scores = zipf_scores(model)
    pieces, texts, byte_ids = {}, [], [0] * 256
    for i, piece in enumerate(model.pieces):
        text = piece.piece.replace(SPACE, " ").encode()
        if piece.type == NORMAL:
            if SPACE in piece.piece.lstrip(SPACE) or "\n" in piece.piece or _APART.search(piece.piece):
                raise ValueError(f"piece {i} reaches over the end of a stretch")
            pieces[piece.piece] = i
        elif piece.type == BYTE:
            byte = int(piece.piece[1:-1], 16)
            byte_ids[byte], text = i, bytes([byte])
        else:
            text = b""
        texts.append(text)
    least = min(scores[i] for i in pieces.values())
    return Vocabulary(pieces, np.array(scores), texts, byte_ids, least - UNKNOWN_PENALTY)


def library_model(path: str) -> bytes:
    """The model as a file of the SentencePiece library."""
    model = _proto(path)
    for piece, score in zip(model.pieces, zipf_scores(model), strict=True):
        piece.score = score / UNIT
    model.trainer_spec.model_type = 1
    return model.SerializeToString()


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text that is not empty after one more space; bytes and bounds."""
    some = np.diff(offsets) > 0
    shift = np.concatenate([[0], np.cumsum(some)])
    out = np.full(len(data) + int(shift[-1]), 32, np.uint8)
    moved = np.ones(len(out), bool)
    moved[(offsets[:-1] + shift[:-1])[some]] = False
    out[moved] = data
    return out, offsets + shift


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin: at a text's first byte, at a space after something else, between
    an ASCII letter and another ASCII character, at and after a line end."""
    begin = np.zeros(len(data), bool)
    line, space = data == 10, data == 32
    letter, other = _LETTER[data], _OTHER[data]
    begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    begin[1:] |= (letter[1:] & other[:-1]) | (letter[:-1] & other[1:])
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begin)


def without_marks(text: str | None) -> str:
    """U+2581 in a text is what a space becomes."""
    return (text or "").replace(SPACE, " ")
