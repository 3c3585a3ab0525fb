"""Token counts of a unigram tokenizer without its tokens: Aho-Corasick matches and a count-only Viterbi pass.

The vocabulary comes from a sentencepiece model file: its normal pieces with their scores, and its byte pieces
for what no piece covers.  An automaton over the pieces lists every match in a word; a pass over the word's
positions keeps, for each, the best score of a segmentation up to there and the number of its pieces.  Ties
follow the tokenizer: a later candidate replaces an earlier one only if it scores strictly higher, candidates
come in order of their start and then of length, and a character that is no piece itself costs the least score
less ten and is spelled in bytes.

Words are pre-split as the tokenizer does: blanks become the word mark, a mark is put in front, and each mark
starts a word.  A worker counts each distinct word once and remembers short ones up to a bounded number of
characters; what it has forgotten is counted again.  A word of any length costs 16 bytes a character while it is counted.

Nulls, ties and repeats: a null or empty text has no tokens; rows are counted one by one; texts are counted
whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of distinct words, and 64 for each word, that a worker remembers before it starts again (at most four bytes each), and the longest such word.
REMEMBER, LONGEST = 32 << 20, 256


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the normal pieces of a sentencepiece model file, in order of id; runs of marks, which no word holds, are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) or MARK in m.id_to_piece(i)[1:])]


class Counter:
    """Counts the pieces of the best segmentation of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.held = 0

    def word(self, word: str) -> int:
        """Pieces of one word, mark included."""
        # matches come by their end, and for one end from the earliest start on: the order in which the tokenizer tries them
        best, count = array("d", [0.0]), array("q", [0])
        matches = self.automaton.iter(word)
        last, found = next(matches, (len(word), None))
        for i, char in enumerate(word):
            score, pieces, single = None, 0, False
            while last == i:
                n, own = found
                single |= n == 1
                if score is None or best[i + 1 - n] + own > score:
                    score, pieces = best[i + 1 - n] + own, count[i + 1 - n] + 1
                last, found = next(matches, (len(word), None))
            if not single and (score is None or best[i] + self.unknown > score):
                score, pieces = best[i] + self.unknown, count[i] + len(char.encode("utf-8", "surrogatepass"))
            best.append(score)
            count.append(pieces)
        return count[-1]

    def text(self, text: str | None) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        total, known = 0, self.known
        parts = text.replace(" ", MARK)
        for part in (parts if parts[0] == MARK else MARK + parts).split(MARK)[1:]:
            n = known.get(part)
            if n is None:
                n = self.word(MARK + part)
                if len(part) <= LONGEST:
                    if self.held > REMEMBER:
                        known.clear()
                        self.held = 0
                    known[part] = n
                    self.held += len(part) + 64
            total += n
        return total


_counters: dict[str, Counter] = {}


def count(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_tokens per row of ``docs`` (doc_id, text); ``pieces`` is a whole vocabulary, tens of thousands of rows."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    name = hashlib.sha256(repr(pieces).encode()).hexdigest()

    def run(batches):
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(sent.value)
        counter = _counters[name]
        for batch in batches:
            texts = batch.column("text")
            n = [counter.text(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")
