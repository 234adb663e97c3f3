"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece that ends at each place of a word; dynamic
programming carries the best score and the number of pieces of the best way there, so no path is kept.
Rules of the exact tokenizer: a later way wins only with a higher score, ways are tried from the longest
piece on; a character that is no piece of its own costs ten less than the lowest score; unknown
characters in a row are one token, or one per byte where the vocabulary has byte pieces.

Words begin at blanks and no piece goes across a blank, so a text's figures are the sums of its words'.
Defined cases: null and empty texts have no tokens and score 0; equal rows count alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import small_batches

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
MOST_WORDS = 400_000
LONGEST_KEPT = 64


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a public SentencePiece file with unigram scores by Zipf's law on their rank."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(pieces.id_to_piece(i), -math.log(i + 1.0)) for i in range(pieces.get_piece_size())]


class Counter(dict):
    """word (with its leading blank mark) -> (pieces, score) of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_pieces: bool = True):
        super().__init__()
        self._scores = dict(vocabulary)
        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(self._scores.values()) - UNKNOWN_PENALTY
        self._bytes = byte_pieces and all(f"<0x{b:02X}>" in self._scores for b in range(256))

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.best(word)
        if len(self) < MOST_WORDS and len(word) <= LONGEST_KEPT:
            self[word] = found
        return found

    def best(self, word: str) -> tuple[int, float]:
        """(number of tokens, score) of the best segmentation of one word."""
        score, count, unknown = [0.0], [0], [False]  # at each place so far
        here, best, at, single = 0, 0.0, 0, True  # the place whose pieces are being seen
        for end, (length, own) in self._automaton.iter(word):  # by place, the longest piece first
            if end >= here:
                while here <= end:
                    if here:
                        self._close(word, score, count, unknown, best, at, single)
                    here += 1
                    best, at, single = -math.inf, 0, False
            total = own + score[end + 1 - length]
            if total > best:
                best, at = total, end + 1 - length
            if length == 1:
                single = True
        while here <= len(word):
            if here:
                self._close(word, score, count, unknown, best, at, single)
            here += 1
            best, at, single = -math.inf, 0, False
        return count[-1], score[-1]

    def _close(self, word, score, count, unknown, best, at, single) -> None:
        """Enter the best way to the next place."""
        if not single and (total := self._unknown + score[-1]) > best:
            pieces = len(word[len(score) - 1].encode()) if self._bytes else not unknown[-1]
            score.append(total)
            count.append(count[-1] + pieces)
            unknown.append(True)
        else:
            score.append(best)
            count.append(count[at] + 1)
            unknown.append(False)

    def text(self, text: str | None) -> tuple[int, float]:
        """(number of tokens, score) of a whole text."""
        if not text:
            return 0, 0.0
        words = text.replace(BLANK, " ").split(" ")
        if not words[0]:
            words = words[1:]
        found = [self[BLANK + w] for w in words]
        return sum([n for n, _ in found]), math.fsum([s for _, s in found])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One table per worker process and vocabulary."""
    return Counter(zipf_vocabulary(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and best_score of every whole text; a projection without a shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(path)
        for batch in small_batches(batches):
            found = [words.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "n_tokens", "best_score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_tokens long, best_score double")
