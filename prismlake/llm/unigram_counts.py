"""Token counts of a unigram tokenizer without building the tokens: count-only Viterbi.

The vocabulary is a list of pieces with scores. A text is prepared as the tokenizer does: a blank becomes the mark U+2581,
and one mark stands before the text. An Aho-Corasick automaton enumerates the pieces that end at each character, and
dynamic programming carries, for each end, the best score and the number of pieces on the way to it.

Ties are the tokenizer's: a way replaces another only if its score is higher, and ways are tried from the earliest start,
so the longest last piece wins. A character without a piece of its own costs UNKNOWN less than the lowest score, and is
spelt in as many byte pieces as its UTF-8 has bytes.

No piece has a mark after another character, so a text falls into units (marks, then other characters) that are counted on
their own; each distinct unit of a task is counted once, in a table of at most MOST_UNITS units that is begun anew when it is
full.

Defined cases: a null text has null, an empty one no tokens; repeated rows and null ids are kept as they are; extra columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK, UNKNOWN, MOST_UNITS = "▁", 10.0, 400_000
#: A long unit is not kept.
LONG_UNIT = 64
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class Vocabulary:
    """Pieces with their scores; fewer than a tokenizer file holds."""

    pieces: dict[str, float]

    @property
    def unknown(self) -> float:
        return min(self.pieces.values(), default=0.0) - UNKNOWN


def load(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model: not control, unknown, unused or byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    found = Vocabulary({model.id_to_piece(i): model.get_score(i) for i in plain})
    if any(MARK in p.lstrip(MARK) for p in found.pieces):
        raise ValueError("a piece has a mark after another character: units can't be counted on their own")
    return found


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = vocabulary.unknown
        self.known: dict[str, int] = {}

    def unit(self, s: str) -> int:
        """The number of pieces on the best way through a unit."""
        n = len(s)
        ending: list[list] = [[] for _ in range(n + 1)]
        if len(self.matches):
            for last, found in self.matches.iter(s):  # at each end the longest first
                ending[last + 1].append(found)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top = None
            for length, score in ending[end]:
                way = best[end - length] + score
                if top is None or way > top:
                    top, pieces = way, count[end - length] + 1
            if not ending[end] or ending[end][-1][0] > 1:  # no piece of one character ends here
                way = best[end - 1] + self.unknown
                if top is None or way > top:
                    top, pieces = way, count[end - 1] + len(s[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[n]

    def text(self, text: str | None) -> int | None:
        if not text:
            return None if text is None else 0
        total, known = 0, self.known
        for unit in _UNIT.findall(MARK + text.replace(" ", MARK)):
            got = known.get(unit)
            if got is None:
                got = self.unit(unit)
                if len(unit) <= LONG_UNIT:
                    if len(known) >= MOST_UNITS:
                        known.clear()
                    known[unit] = got
            total += got
        return total


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and n_tokens of every row of `docs` (doc_id, text). The vocabulary travels as a broadcast: its size is the file's."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([counter.text(t) for t in part.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")
