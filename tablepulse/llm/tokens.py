"""Token counts by a Viterbi search that keeps counts instead of pieces.

The text is split as a unigram tokenizer does: spaces become ``▁``, one is put in front, and every ``▁`` begins a new
word. In a word an Aho-Corasick automaton lists all pieces of the vocabulary with their ends. For every end, in
ascending order, dynamic programming keeps the best score and the number of pieces on the best path, and nothing else.

Tie rules of the tokenizer: candidates for an end are taken from the earliest start on, and a later one only replaces
the best if its score is strictly greater, so the longest last piece wins. Scores are added from left to right in double
precision. A character that is no piece of its own also is a candidate as unknown, with the smallest score of the
vocabulary less 10. Unknown characters that follow each other are one token, or one per UTF-8 byte if the vocabulary
has all byte pieces.

Words repeat, so every worker keeps the counts of up to ``KEPT_WORDS`` words and starts anew beyond. A word of any length
takes one pass; only its scores are held. NULL and empty texts have no tokens. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 400_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and scores, without control and unknown symbols; byte pieces come as ``<0xNN>``."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i))]


class Counter(dict):
    """Word -> number of tokens, computed at the first lookup."""

    def __init__(self, vocabulary: list[tuple[str, float]], kept: int = KEPT_WORDS):
        super().__init__()
        self.kept = kept
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary}
        self.single = {p for p in names if len(p) == 1}
        self.bytewise = all(f"<0x{b:02X}>" in names for b in range(256))

    def __missing__(self, word: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        count = self[word] = self.count_word(word)
        return count

    def count_word(self, word: str) -> int:
        """Tokens on the best path through one word.

        The automaton lists the pieces by ascending end and, for one end, from the longest, that is from the earliest
        start. Keeping the first of equal scores is the tie rule.
        """
        size = len(word)
        score, count = [0.0] + [float("-inf")] * size, [0] * (size + 1)
        if not self.single.issuperset(word):
            return self._with_unknown(word, score, count)
        for last, (length, piece_score) in self.automaton.iter(word):
            start, end = last + 1 - length, last + 1
            candidate = score[start] + piece_score
            if candidate > score[end]:
                score[end], count[end] = candidate, count[start] + 1
        return count[size]

    def _with_unknown(self, word: str, score: list[float], count: list[int]) -> int:
        """The same for a word with characters that are no pieces."""
        open_run = [False] * len(count)  # the best path to here ends in unknown characters
        pieces = chain(self.automaton.iter(word), ((len(word), None),))
        last, piece = next(pieces)
        for end, character in enumerate(word, 1):
            while last + 1 == end:
                length, piece_score = piece
                candidate = score[end - length] + piece_score
                if candidate > score[end]:
                    score[end], count[end] = candidate, count[end - length] + 1
                last, piece = next(pieces)
            if character not in self.single and score[end - 1] + self.unknown > score[end]:
                score[end], open_run[end] = score[end - 1] + self.unknown, True
                new = len(character.encode("utf-8", "surrogatepass")) if self.bytewise else not open_run[end - 1]
                count[end] = count[end - 1] + new
        return count[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        spaced = text.replace(" ", SPACE)
        spaced = spaced if spaced.startswith(SPACE) else SPACE + spaced
        return sum(self[SPACE + w] for w in spaced[1:].split(SPACE))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(read_vocabulary(path))
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_chars, n_tokens`` per row; ``n_chars`` counts the characters of the text itself."""
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), chars, "text")
    return rows.mapInArrow(_count(path), "doc_id long, n_chars long, n_tokens long")
