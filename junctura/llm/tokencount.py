"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's matches; for each end position the best score and its
piece count are carried.  Ties go as in public unigram tokenizers: of equal scores the earlier
start stays, a character without a piece of its own may be unknown at the lowest score less 10,
and unknown characters fall back to one piece a UTF-8 byte.

No piece holds a space mark after another character, so texts fall apart before each run of
spaces, and distinct parts are decoded once.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_PIECES = 1_000_000
WINDOW = 1 << 16  # characters whose scores are held at once
NO_MATCH = (-1, (0, 0.0))
CACHED_PARTS, CACHED_CHARS = 500_000, 64
SCHEMA = "doc_id bigint, n_chars bigint, n_tokens bigint, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece file and their scores, read on the driver."""
    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary file at {path}; give its place as `path`")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counting:
    """Counts pieces of whole texts."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.trie = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.longest = max(len(p) for p, _ in vocabulary)
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p, _ in vocabulary):
            raise ValueError("a piece holds a space mark after another character")
        cuts = "".join(re.escape(c) for c in "\n\r\t" if not any(c in p for p, _ in vocabulary))
        self.parts = re.compile(f"{MARK}+[^{MARK}{cuts}]*|[^{MARK}{cuts}]+" + f"|[{cuts}]" * bool(cuts)).findall
        self.known: dict[str, tuple[int, float]] = {}

    def part(self, s: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        best, count = [0.0], [0]
        matches = self.trie.iter(s)
        end, match = next(matches, NO_MATCH)
        for e, character in enumerate(s):
            b, c = float("-inf"), 0
            while end == e:  # the longest first, so the earliest start
                size, score = match
                if (v := best[-size] + score) > b:
                    b, c = v, count[-size] + 1
                end, match = next(matches, NO_MATCH)
            if character not in self.single and (v := best[-1] + self.unknown) > b:
                b, c = v, count[-1] + len(character.encode())
            best.append(b)
            count.append(c)
            if len(best) > WINDOW + self.longest:  # no piece reaches further back
                del best[: -self.longest], count[: -self.longest]
        return count[-1], best[-1]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        tokens, total = 0, 0.0
        for part, times in Counter(self.parts(MARK + text.replace(" ", MARK))).items():
            if (got := self.known.get(part)) is None:
                got = self.part(part)
                if len(part) <= CACHED_CHARS:
                    if len(self.known) >= CACHED_PARTS:
                        self.known.clear()
                    self.known[part] = got
            tokens += got[0] * times
            total += got[1] * times
        return tokens, total


@cache
def _counting(handle) -> Counting:
    """One a worker: workers are used again for the next task."""
    return Counting(handle.value)


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, n_chars, n_tokens, score) for each row of `docs`.

    Null and empty texts have 0 tokens and score 0; whole texts count, however long; null keys
    stay null; repeated rows count each; other columns are ignored.  The vocabulary is sent to
    executors once, at most MAX_PIECES pieces.
    """
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"{len(vocabulary)} pieces; at most {MAX_PIECES} are sent to executors")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(sent)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counting.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array((c for c, _ in counts), pa.int64()), pa.array((s for _, s in counts), pa.float64())], schema=_ARROW)

    return docs.selectExpr(f"cast({key} as bigint) doc_id", text).mapInArrow(run, SCHEMA)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), load_vocabulary())


SQL: dict[str, str] = {}
QUERIES = {"op3_token_counts": op3_token_counts}
