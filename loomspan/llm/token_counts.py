"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character of a word; dynamic programming keeps, for
every place, the best score and the number of pieces on the best path, never the path. Ties and unknown characters follow
the unigram tokenizer of the ``tokenizers`` library: scores are 64-bit, a later candidate wins only if strictly better and
candidates come by their start; a character without a piece of its own costs ten below the least score; unknown characters
in a row are one piece, or their bytes where the vocabulary has byte pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import WORD, text_slices

_WORDS = re.compile(WORD).findall
UNKNOWN_PENALTY = 10.0
MARK = "▁"


class UnigramCounter:
    """Counts the pieces of words of ``MARK`` and the word, as the library's unigram model with a metaspace pre-tokenizer."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int | None, most: int = 500_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece != (pieces[unknown][0] if unknown is not None else None):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.single = {p for p in names if len(p) == 1}
        self.held: dict[str, int] = {}
        self.most = most

    def count_word(self, word: str) -> int:
        """Pieces on the best path through one word."""
        best: list = [None] * (len(word) + 1)
        count, lone = [0] * (len(word) + 1), [False] * (len(word) + 1)  # lone: the last piece is an unknown character
        best[0], start, done = 0.0, [0] * (len(word) + 1), 0

        def close(upto: int) -> None:
            """Settle all places up to ``upto``: no match ends there any more."""
            for place in range(done + 1, upto + 1):
                char = word[place - 1]
                if char not in self.single:
                    score = best[place - 1] + self.unknown_score
                    if best[place] is None or score > best[place]:
                        best[place], start[place], lone[place] = score, place - 1, True
                begin = start[place]
                if not lone[place]:
                    count[place] = count[begin] + 1
                elif self.bytes:
                    count[place] = count[begin] + len(char.encode("utf-8", "surrogatepass"))
                else:
                    count[place] = count[begin] + (not lone[begin])

        for end, (size, score) in self.automaton.iter(word):  # at each end the longest comes first: candidates by their start
            if end > done:
                close(end)
                done = end
            score += best[end + 1 - size]
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1], start[end + 1] = score, end + 1 - size
        close(len(word))
        return count[-1]

    def count(self, text: str) -> int:
        held, total = self.held, 0
        for word in _WORDS(text):
            n = held.get(word)
            if n is None:
                if len(held) >= self.most:
                    held.clear()
                n = self.count_word(word if word[0] == MARK else MARK + word)
                if len(word) <= 64:
                    held[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def sentencepiece_counter(path: str) -> UnigramCounter:
    """The pieces and scores of a sentencepiece file, read as a unigram vocabulary."""
    pieces, unknown = vocabulary(path)
    return UnigramCounter(pieces, unknown)


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


def token_counts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_tokens``.

    Words part at ASCII white space; each is counted with the word mark before it. A null or empty text has 0 tokens,
    repeated rows get equal counts, an empty table gives no rows, other columns are not read. A word's memory and time
    grow with its length; texts are not cut.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        counter = sentencepiece_counter(vocabulary_path)
        for batch, texts in text_slices(batches, 1):
            counts = np.fromiter(map(counter.count, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["id", "n_tokens"])

    return source.mapInArrow(run, f"id {kind}, n_tokens long")
