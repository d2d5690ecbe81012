"""Numbers of unigram tokens by a Viterbi search that carries only scores and counts.

An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at each character,
longest first; the best score there is replaced only by a better one, so of equal segmentations
the one whose last piece is longest stays, as in the SentencePiece library. A character without
a piece of its own may be unknown; it counts as its bytes. Lattices fall apart into stretches
(``unigram``), so a worker searches every different stretch once.

Null and empty texts have no tokens and score 0. Repeated rows each give a row; an empty table
gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm import unigram
from watchfold.llm.shared import documents, in_worker, ship
from watchfold.llm.tokens import CHUNK, MOST_KEPT, Seen, strings, vocabulary


class Counter:
    def __init__(self, model: unigram.Vocabulary):
        import ahocorasick

        self.unknown = model.unknown
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.pieces.items():
            self.automaton.add_word(piece, (len(piece), int(model.scores[i])))
        self.automaton.make_automaton()
        self.seen = Seen()
        self.clear()

    def clear(self) -> None:
        self.seen.clear()
        self.score, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def best(self, stretch: str) -> tuple[int, int]:
        """(score, tokens) of the best segmentation."""
        text = stretch.replace(" ", unigram.SPACE)
        n, unknown = len(text), self.unknown
        score: list[int | None] = [0] + [None] * n
        count = [0] * (n + 1)
        settled = 0  # ends up to here are final
        single = 0   # the last end of a piece of one character

        def settle(to: int) -> None:
            # A character that is no piece may be unknown; it comes after all longer pieces.
            nonlocal settled
            for end in range(settled + 1, to + 1):
                if single != end:
                    value = score[end - 1] + unknown
                    if score[end] is None or value > score[end]:
                        score[end], count[end] = value, count[end - 1] + len(text[end - 1].encode())
            settled = max(settled, to)

        for last, (length, own) in self.automaton.iter(text):
            end, begin = last + 1, last + 1 - length
            if settled < last:
                settle(last)
            value = score[begin] + own
            if score[end] is None or value > score[end]:
                score[end], count[end] = value, count[begin] + 1
            if length == 1:
                single = end
        settle(n)
        return score[n], count[n]

    def _learn(self, stretches: list[str]) -> None:
        found = np.array([self.best(s) for s in stretches], np.int64).reshape(-1, 2)
        self.score = np.concatenate([self.score, found[:, 0]])
        self.count = np.concatenate([self.count, found[:, 1]])

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score in 1 / UNIT, tokens) of each text."""
        data, offsets = strings(texts)
        score, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            part, bounds = unigram.spaced(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            if len(part):
                start = unigram.starts(part, bounds)
                row = self.seen.find(part, start, np.append(start[1:], len(part)), self._learn)
                of = np.searchsorted(bounds, start, "right") - 1
                np.add.at(score, at + of, self.score[row])
                np.add.at(count, at + of, self.count[row])
                if len(self.seen.keys) > MOST_KEPT:
                    self.clear()
            at = to
        return score, count


def counts(docs: DataFrame, text_col: str = "text", into: str = "tokens",
           path: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``into``: n_tokens and the score of the best segmentation."""
    ship(docs.sparkSession)

    def count(texts: pa.Array) -> pa.Array:
        place = path or vocabulary("piece_bpe_32k.model")
        counter = in_worker(("count", place), lambda: Counter(unigram.load(place)))
        score, n = counter.totals(pc.replace_substring(texts, unigram.SPACE, " "))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(score / unigram.UNIT)], names=["n_tokens", "score"])

    return docs.withColumn(into, F.arrow_udf(count, "struct<n_tokens: long, score: double>")(F.col(text_col)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "tokens.n_tokens", "tokens.score")
