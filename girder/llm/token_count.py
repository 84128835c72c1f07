"""Token counts of a unigram piece model without its tokens.

The Viterbi search of a unigram model keeps, for each place in a text, the best
score of a segmentation up to there; for counts it is enough to carry the number
of pieces beside the score.  An Aho-Corasick automaton over the vocabulary finds
all pieces of a word at once.

The counts are the library's own, ties included: sums are kept in double precision
from the start of the text, places are visited from the left, shorter pieces
first, and only a greater sum replaces one.  No piece crosses from a visible
character to a following space mark, and sums of the scores, which have few bits,
are exact; so each word is searched for itself, once, and its count remembered.
A text so long that its sums might round is searched as a whole.

The vocabulary is a sentencepiece model file with byte fallback and identity
normalisation.  A model of another kind is read as a unigram one: the scores of a
BPE file are merge ranks and placeholders and not log probabilities, so its
pieces get Zipf's, minus the logarithm of the piece's place, unless the scores of
the file are asked for.  Begin and end ids are not counted.

Cases: null and empty texts have no tokens; a character without a piece counts
one token a UTF-8 byte; a text of any length is counted whole; repeated rows get
equal counts; an empty table gives no rows; other columns pass through, and an
output name that is taken gets a leading underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from girder.llm.pieces import SPACE, default_model
from girder.llm.shared import fresh, table

REMEMBERED = 400_000


def zipf(i: int) -> float:
    """The score of the piece with id i, in the single precision of model files."""
    return float(np.float32(-log(i + 1)))


class Counter(dict):
    """The number of pieces by word, searched when it is first asked for."""

    def __init__(self, proto: bytes, own_scores: bool = False):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        if not any(sp.is_byte(i) for i in range(size)):
            raise ValueError("this model has no byte fallback")
        pieces = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        vocabulary = {sp.id_to_piece(i): sp.get_score(i) if own_scores else zipf(i) for i in pieces}
        if any(SPACE in name.lstrip(SPACE) for name in vocabulary):
            raise ValueError("this model has pieces over several words")
        self.automaton = ahocorasick.Automaton()
        for name, score in vocabulary.items():
            self.automaton.add_word(name, (len(name), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.values()) - 10.0
        # sums below this are exact: a double has 53 bits from the scores' lowest one up
        scores = np.array([*vocabulary.values(), self.unknown])
        step = min((float(np.ldexp(1.0, int(np.frexp(x)[1]) - 24)) for x in np.abs(scores[scores != 0])), default=1.0)
        whole = bool((scores == np.floor(scores)).all())
        self.most_pieces = 2.0**53 * (1.0 if whole else step) / float(np.abs(scores).max() or 1.0)
        # a line end that no longer piece holds is a word of its own
        line = "" if any("\n" in name and len(name) > 1 for name in vocabulary) else "\n"
        self.words = re.compile((f"{line}|" if line else "") + f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+").findall

    def search(self, word: str) -> int:
        n = len(word)
        starting: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (length, value) in self.automaton.iter(word):
            starting[last - length + 1].append((last + 1, value))
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        for i, own in enumerate(starting):
            here, pieces = best[i], count[i] + 1
            for end, value in own:
                total, old = here + value, best[end]
                if old is None or total > old:
                    best[end], count[end] = total, pieces
            if not own or own[0][0] != i + 1:
                # no piece is this character alone: its bytes
                total, old = here + self.unknown, best[i + 1]
                if old is None or total > old:
                    best[i + 1], count[i + 1] = total, count[i] + len(word[i].encode())
        return count[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.search(word)
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (SPACE + text).replace(" ", SPACE)
        # no more pieces than bytes
        if 3 * len(marked) + 3 > self.most_pieces:
            return self.search(marked)
        return sum(map(self.__getitem__, self.words(marked)))


@lru_cache(maxsize=2)
def counter(proto: bytes, own_scores: bool) -> Counter:
    return Counter(proto, own_scores)


def token_counts(docs: DataFrame, text: str = "text", model: str | None = None, own_scores: bool = False) -> DataFrame:
    """docs with n_tokens."""
    with open(model or default_model(), "rb") as f:
        proto = f.read()
    (name,) = fresh(docs, "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(proto, own_scores).count
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            counts = [count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole text; a null or empty text has none, and an empty table gives no rows."""
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
