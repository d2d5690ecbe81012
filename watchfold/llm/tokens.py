"""Token ids of whole texts by the tokenizers library, looked up by stretches.

Texts are cut where both kinds of vocabulary always begin a new word: at ASCII white space, and
between an ASCII letter and ASCII punctuation other than the apostrophe. A text's ids are its
stretches' ids in a row, so a worker asks the library only for stretches it has not met, and
finds the others by a 64-bit hash in arrays. Nothing is cut beside other bytes, digits or
apostrophes, and a text that may hold a special token is one stretch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from watchfold.llm.near_dedup import _BASE, _powers, mix

MOST_KEPT = 1_500_000  # stretches in a worker's table, about 30 bytes each
CHUNK = 1 << 21        # bytes of text in work at a time

OTHER, LETTER, MARK, SPACE, LATIN = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
for _c in range(128):
    if chr(_c).isalpha():
        _CLASS[_c] = LETTER
    elif 33 <= _c < 127 and not chr(_c).isdigit() and chr(_c) != "'":
        _CLASS[_c] = MARK
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[0xC3] = LATIN  # first byte of U+00C0 to U+00FF, none of which is white space


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row (null: empty) and their bounds."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Seen:
    """Stretches met so far: their hashes, sorted, and the number under which each was learned."""

    def __init__(self, fold: np.ndarray | None = None):
        self.fold = fold
        self.up, self.down = _powers(_BASE, CHUNK), _powers(pow(_BASE, -1, 1 << 64), CHUNK)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, learn: Callable[[list[str]], None]) -> np.ndarray:
        """Number of each stretch; ``learn`` is given the new ones, to be numbered in its order."""
        if len(data) >= len(self.up):
            grown = 1 << int(len(data)).bit_length()
            self.up, self.down = _powers(_BASE, grown), _powers(pow(_BASE, -1, 1 << 64), grown)
        folded = data if self.fold is None else self.fold[data]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=total[1:])
        key = mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw, s, e = data.tobytes(), start[first[new]].tolist(), end[first[new]].tolist()
            learn([raw[a:b].decode() for a, b in zip(s, e, strict=True)])
            numbers = len(self.rows) + np.arange(len(new))
            self.keys, self.rows = np.insert(self.keys, place[new], unique[new]), np.insert(self.rows, place[new], numbers)
            place = np.searchsorted(self.keys, unique)
        return self.rows[place][inverse]


class Encoder:
    def __init__(self, path: str, spaced: bool):
        """``spaced``: the vocabulary's words begin with their space (byte-level); otherwise
        white space and the case of letters make no difference to it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        fold = np.arange(256, dtype=np.uint8)
        if not spaced:
            fold[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
        self.seen = Seen(fold)
        self.clear()

    def clear(self) -> None:
        self.seen.clear()
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _learn(self, stretches: list[str]) -> None:
        found = self._ask(stretches)
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), self.kind, int(size.sum()))])

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where stretches begin."""
        kind = _CLASS[data]
        begin = np.zeros(len(data), bool)
        left, right = kind[:-1], kind[1:]
        begin[1:] = ((left == LETTER) & (right == MARK)) | ((left == MARK) & (right == LETTER))
        if self.spaced:
            # A single space belongs to what follows it.
            follow = (right == LETTER) | (right == MARK) | (right == LATIN)
            follow |= (right == OTHER) & (data[1:] < 128) & (data[1:] > 32)
            begin[:-1] |= (data[:-1] == 32) & follow
        else:
            begin[1:] |= (left == SPACE) != (right == SPACE)
        for i in self._whole_texts(data, offsets):
            begin[offsets[i]:offsets[i + 1]] = False
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(begin)

    def _whole_texts(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        if not self.special:
            return []
        first = min(s[0] for s in self.special)
        if len({s[:2] for s in self.special}) == 1:
            head = self.special[0][:2]
            hits = np.flatnonzero((data[:-1] == head[0]) & (data[1:] == head[1]))
        else:
            hits = np.flatnonzero(data == first)
        return np.unique(np.searchsorted(offsets, hits, "right") - 1).tolist()

    def _ask(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each text)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        start = self._starts(data, offsets)
        end = np.append(start[1:], len(data))
        if not self.spaced:
            word = _CLASS[data[start]] != SPACE
            for i in self._whole_texts(data, offsets):
                word |= start == offsets[i]
            start, end = start[word], end[word]
        row = self.seen.find(data, start, end, self._learn)
        count = self.size[row]
        upto = np.cumsum(count)
        index = np.repeat(self.at[row] - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
        ids = self.ids[index]
        of = np.searchsorted(offsets, start, "right") - 1
        each = np.bincount(of, count, minlength=n).astype(np.int64)
        # A full table starts anew.
        if len(self.seen.keys) > MOST_KEPT or len(self.ids) > 8 * MOST_KEPT:
            self.clear()
        return ids, each

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, last text, ids in a row, tokens of each text) for chunks of whole texts."""
        data, offsets = strings(texts)
        at, n = 0, len(texts)
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
            to = min(max(to, at + 1), n)
            yield at, to, *self._chunk(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            at = to


class FastEncoder(Encoder):
    """The byte-level vocabulary, asked through tiktoken where that is the same: on stretches of
    ASCII and U+00C0 to U+00FF, whose classes no Unicode version has changed."""

    def __init__(self, path: str, ranks: str):
        super().__init__(path, spaced=True)
        import base64
        import re

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                          special_tokens={}).encode_ordinary
        self.plain = re.compile(r"[\t\n\r -~À-ÿ]*").fullmatch

    def _ask(self, stretches: list[str]) -> list[list[int]]:
        odd = [i for i, s in enumerate(stretches) if "<|" in s or not self.plain(s)]
        out = [None] * len(stretches)
        for i, ids in zip(odd, super()._ask([stretches[i] for i in odd]), strict=True):
            out[i] = ids
        ordinary = self.ordinary
        return [ordinary(s) if ids is None else ids for s, ids in zip(stretches, out, strict=True)]


class WordEncoder(Encoder):
    """The vocabulary of words with an end. A stretch of letters of ASCII and U+00DF to U+00FF is
    one word; its merges are done by tiktoken, with the end of the word as a byte of its own that
    joins the last letter first. Other stretches go to the tokenizers library."""

    END = "\0"

    def __init__(self, path: str):
        super().__init__(path, spaced=False)
        import json
        import re

        import tiktoken

        with open(path, encoding="utf-8") as text:
            model = json.load(text)["model"]
        suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
        # Printable bytes stand for themselves in such files, the others for U+0100 and up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

        def raw(token: str) -> bytes:
            ended = token.endswith(suffix)
            body = bytes(byte_of[c] for c in (token[:-len(suffix)] if ended else token))
            return body + self.END.encode() * ended

        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        single = [c for c in byte_of if byte_of[c]]
        order = [*single, *(c + suffix for c in single), *merged]
        ranks = {self.END.encode(): 0}
        ids = [0]
        for token in order:
            if raw(token) not in ranks:
                ranks[raw(token)] = len(ids)
                ids.append(vocabulary[token])
        self.id_of = np.array(ids)
        self.ends = np.array([key.endswith(self.END.encode()) for key in ranks])
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.one_word = re.compile(r"[a-zß-öø-ÿ]+").fullmatch

    def _ask(self, stretches: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(stretches)
        simple = [i for i, s in enumerate(stretches) if self.one_word(s)]
        odd = sorted(set(range(len(stretches))).difference(simple))
        for i, ids in zip(odd, super()._ask([stretches[i] for i in odd]), strict=True):
            out[i] = ids
        if simple:
            rank = np.array(self.words.encode_ordinary(self.END.join([*(stretches[i] for i in simple), ""])))
            cuts = (np.flatnonzero(self.ends[rank]) + 1).tolist()
            ids = self.id_of[rank].tolist()
            for k, i in enumerate(simple):
                out[i] = ids[cuts[k - 1] if k else 0:cuts[k]]
        return out


def byte_level() -> Encoder:
    return FastEncoder(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def lower_case() -> Encoder:
    return WordEncoder(vocabulary("word_bpe_49k.json"))
