"""Token counts without tokens: Viterbi over a unigram vocabulary that carries only a score and a count.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character, longest first. The best path to a
character is that of the highest score; of equal scores the longer last piece stands, which is the rule of the public
unigram tokenizers (a later start must be strictly better). A character that no piece spells alone costs ten less than
the lowest score, and counts as its UTF-8 bytes where the vocabulary has byte pieces, else as one piece a run.

Pieces hold the space mark at their beginning only, so no piece crosses from a word into the mark after it, and where
all scores are integers sums are exact in double precision: the best path of a text is then that of its words in
order, ties included. Words are kept in a bounded table, so common ones are solved once. Where a vocabulary lacks
either property, or joins unknown characters into one piece, which may reach over a mark, the whole text is one lattice.

Normalization is that of the vocabulary's own tokenizer: a mark before the text, spaces to marks, nothing else.

Defined cases. Null and empty texts have no tokens and score 0. Repeated rows and null doc_ids are counted like any
other. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, prepare

MARK = "▁"
_WORDS = re.compile(r" *[^ ]+| +")


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(pieces with scores, whether all byte pieces are there) of a sentencepiece file; control, unknown and byte
    pieces spell no text."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.vocab_size())
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return pieces, sum(m.is_byte(i) for i in ids) == 256


class Counter:
    """Scores and counts of texts under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, cap: int = 400_000):
        import ahocorasick
        import numpy as np

        self.tree = ahocorasick.Automaton()
        for p, s in pieces:
            self.tree.add_word(p, (len(p), s))
        self.tree.make_automaton()
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in pieces), default=0.0) - 10
        self.by_word = byte_fallback and all(s == int(s) and abs(s) < 1 << 31 for _, s in pieces) and not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.cap, self.seen = cap, {}
        self.count, self.score = np.zeros(cap + 1, "i8"), np.zeros(cap + 1, "f8")

    def solve(self, text: str) -> tuple[int, float]:
        """(count, score) of one lattice, over normalized text."""
        n = len(text)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0  # ends below this are settled
        pending = None
        single = False

        def settle(end: int) -> None:
            nonlocal pending, single
            if not single:
                s = best[end - 1] + self.unknown
                if pending is None or s > pending[0]:
                    more = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not unk[end - 1])
                    pending = (s, count[end - 1] + more, True)
            best[end], count[end], unk[end] = pending
            pending, single = None, False

        for last, (size, score) in self.tree.iter(text):
            end = last + 1
            while at + 1 < end:
                at += 1
                settle(at)
            start = end - size
            s = best[start] + score
            if pending is None or s > pending[0]:
                pending = (s, count[start] + 1, False)
            single = single or size == 1
        while at < n:
            at += 1
            settle(at)
        return count[n], best[n]

    def measure(self, text: str | None) -> tuple[int, float]:
        import numpy as np

        if not text:
            return 0, 0.0
        text = " " + text.replace(MARK, " ")
        if not self.by_word:
            return self.solve(text.replace(" ", MARK))
        seen = self.seen
        words = _WORDS.findall(text)
        for w in set(words).difference(seen):
            if len(seen) >= self.cap:
                break
            if len(w) <= 64:
                i = seen[w] = len(seen)
                self.count[i], self.score[i] = self.solve(w.replace(" ", MARK))
        known = np.fromiter((i for i in map(seen.get, words) if i is not None), "i8")
        total, score = int(self.count[known].sum()), float(self.score[known].sum())
        if len(known) < len(words):
            for w in words:
                if w not in seen:
                    n, s = self.solve(w.replace(" ", MARK))
                    total, score = total + n, score + s
        if len(seen) >= self.cap:
            seen.clear()
        return total, score


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(*read_vocabulary(path))


def _measure(batches: Iterator, path: str) -> Iterator:
    import pyarrow as pa

    c = _counter(path)
    for b in batches:
        got = [c.measure(t.as_py()) for t in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "best_score"])


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and best_score, for each row; one scan, no shuffle."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _measure(it, path), "doc_id long, n_tokens long, best_score double")


def op4_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the pieces and scores of the 32k piece vocabulary, as a unigram model."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
