"""Token counts under a unigram vocabulary without making tokens.

An Aho-Corasick automaton lists the vocabulary's matches in a word; a Viterbi
pass carries only the best score and its number of pieces. Ties follow the
unigram tokenizer of the ``tokenizers`` library: scores are summed left to right
in double precision, of equal scores at a position the one whose last piece
starts first stays, a character that is no piece costs the lowest score less 10,
and runs of such characters become bytes.

Words are those of the Metaspace rule (a space becomes U+2581, one is put
before the text, and a word begins at each), so a text's count is the sum over
its words, and a word is worked out once per task while it stays in a bounded
memory.

Defined cases: a null or empty text has no tokens; a text of any length is read
whole, and a word of any length costs time in proportion to it; repeated rows are
counted each; other columns pass unchanged except ``n_tokens``, which is replaced;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], float]:
    """Normal pieces and scores of a sentencepiece model, and the lowest score of all its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return pieces, min(model.get_score(i) for i in ids)


class PieceCounter:
    """Counts pieces of words and of texts."""

    def __init__(self, pieces: Sequence[tuple[str, float]], lowest: float, remembered: int = 1_000_000):
        self.matches = ahocorasick.Automaton()
        self.single = set()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.matches.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def word(self, word: str) -> int:
        """Pieces of one marked word."""
        n = len(word)
        best: list[float] = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        at, single = 0, self.single

        def close(upto: int) -> None:
            # Positions whose matches are all in: where the last character is no piece it may stand alone.
            nonlocal at
            while at < upto:
                at += 1
                c = word[at - 1]
                if c not in single and best[at - 1] + self.unknown > best[at]:
                    best[at], count[at] = best[at - 1] + self.unknown, count[at - 1] + len(c.encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.matches.iter(word):  # at each end, the longest match first
            close(end)
            start = end + 1 - length
            total = score + best[start]
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[start] + 1
        close(n)
        return count[n]

    def text(self, text: str | None) -> int:
        """Pieces of a text."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = (marked[1:] if marked[0] == MARK else marked).split(MARK)
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.word(MARK + w)
                if len(known) >= self.remembered:
                    known.clear()
                if len(w) <= 64:
                    known[w] = n
            total += n
        return total


def count_tokens(docs: DataFrame, pieces: Sequence[tuple[str, float]], lowest: float, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``."""
    shared = docs.sparkSession.sparkContext.broadcast((list(pieces), lowest))  # a vocabulary: its size does not follow the corpus

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(*shared.value)
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", n_tokens(F.col(text_col)))
