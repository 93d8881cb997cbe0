"""Benchmark decontamination: n-gram seeds, confirmed by Smith-Waterman alignment.

1. An item's seeds are all its word n-grams, however common, so that an edited copy is found by
   whichever of them it kept.
2. Documents that hold a seed are aligned with the item, word by word, around the seeds.  Before
   that, a window must hold half the item's words, without which no alignment reaches THRESHOLD.

Words are compared in lower case, of all alphabets.

The benchmark is sent to the documents in blocks of at most BLOCK_BYTES, as arrays, so documents
are never shuffled and a passage that is everywhere is no hot key.  Each block costs one scan; the
usual test sets together are one or a few blocks.  An edited copy that has no SEED_WORDS words of
its item in a row left is not found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER_SEP, read, slices, spans, windows, word_hashes

SEED_WORDS = 3
THRESHOLD = 0.5
SHORT_ITEM = 8
MATCH, MISMATCH, GAP = 2, -1, 1
BLOCK_BYTES = 24 << 20
SCHEMA = "doc_id bigint, item_id bigint, score double, n_seeds bigint, first_word bigint, end_word bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def hashed(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = spans(raw, np.array([0, len(raw)]), LETTER_SEP)
    return word_hashes(raw, starts, ends)


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and where it ends in the second."""
    best, end = 0, 0
    row = np.zeros(len(words) + 1, np.int64)
    slope = np.arange(len(words) + 1) * GAP
    for w in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(words == w, MATCH, MISMATCH), row[1:] - GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope  # gaps along the text
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


class Items:
    """A block of the benchmark: its words, its n-grams and who holds them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words = [hashed(t) for _, t in items]
        self.first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        self.words = np.concatenate([*words, np.empty(0, np.uint64)])
        grams = [np.unique(windows(w, SEED_WORDS)) for w in words]
        every = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(words), dtype=np.int32), [len(g) for g in grams])
        order = np.argsort(every, kind="stable")
        self.grams, at = np.unique(every[order], return_index=True)
        self.bounds, self.held_by = np.append(at, len(every)), item[order]

    def item(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, word and gram of every place where a gram stands."""
        runs = windows(hashes, SEED_WORDS)
        if not len(runs) or not len(self.grams):
            return (np.empty(0, np.int64),) * 3
        at = np.searchsorted(self.grams, runs)
        at[at == len(self.grams)] = 0
        place = np.flatnonzero(self.grams[at] == runs)
        doc = np.searchsorted(first, place, "right") - 1
        inside = place + SEED_WORDS <= first[doc + 1]
        return doc[inside], place[inside], at[place[inside]]

    def align(self, words: np.ndarray, places: np.ndarray, grams: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, score, seeds, first word, end word) of items that the document holds."""
        by_item: dict[int, list[int]] = defaultdict(list)
        for p, g in zip(places.tolist(), grams.tolist()):
            for k in self.held_by[self.bounds[g] : self.bounds[g + 1]].tolist():
                by_item[k].append(p)
        for k, seeds in by_item.items():
            item = self.item(k)
            has: Counter[int] | None = None
            m, best, span = len(item), 0, (0, 0)
            reach = 2 * m
            need = m if m >= SHORT_ITEM else 2 * m
            i = 0
            while i < len(seeds):
                j = i
                while j + 1 < len(seeds) and seeds[j + 1] - seeds[j] <= 2 * reach and seeds[j + 1] - seeds[i] <= 8 * reach:
                    j += 1
                lo, hi = max(0, seeds[i] - reach), min(len(words), seeds[j] + SEED_WORDS + reach)
                i = j + 1
                window = words[lo:hi]
                has = Counter(item.tolist()) if has is None else has
                common = Counter(window.tolist()) & has
                if MATCH * sum(common.values()) < need:
                    continue
                score, end = smith_waterman(item, window)
                if score > best:
                    best, span = score, (lo, lo + end)
            if best >= need:
                # the same alignment read backwards ends where it begins
                back = smith_waterman(item[::-1], words[span[0] : span[1]][::-1])[1]
                yield self.ids[k], best / (MATCH * m), len(seeds), span[1] - back, span[1]


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about BLOCK_BYTES; items without an id or words are left out."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower("text").alias("text")).filter("item_id is not null and text is not null").distinct()
    n = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES + 1
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        if block:
            yield sorted((r.item_id, r.text) for r in block)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, score, n_seeds, first_word, end_word) of each document that holds an item.

    score is the alignment's score over that of the whole item, from THRESHOLD to 1; items of
    fewer than SHORT_ITEM words must stand whole, items of fewer than SEED_WORDS are left out.
    The passage is the words from first_word to before end_word.  Null and empty texts, an empty
    benchmark and empty tables give no rows; texts are read whole, however long; null keys stay
    null; repeated rows are reported each; other columns, whatever their names, are ignored.
    """
    bodies = docs.selectExpr(f"cast({key} as bigint) doc_id", f"cast(lower({text}) as binary) body")
    out = None
    for block in blocks_of(benchmark):
        items = Items(block)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for rows, _, found in _aligned(batches, 1, sent.value):
                ids = rows.column(0).to_pylist()
                got = [(ids[d], *hit) for d, hit in found]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), _ARROW.types)], schema=_ARROW)

        part = bodies.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    out = docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out
    return out.withColumnRenamed("doc_id", key)


def _aligned(batches: Iterator[pa.RecordBatch], body: int, items: Items):
    for rows, data, offsets in slices(batches, body):
        starts, ends, first = spans(data, offsets, LETTER_SEP)
        hashes = word_hashes(data, starts, ends)
        doc, place, gram = items.hits(hashes, first)
        found = []
        for d, i, j in _runs(doc):
            lo = first[d]
            found += [(d, hit) for hit in items.align(hashes[lo : first[d + 1]], place[i:j] - lo, gram[i:j])]
        yield rows, rows.num_rows, found


def _runs(doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(doc):
        cuts = [0, *(np.flatnonzero(doc[1:] != doc[:-1]) + 1).tolist(), len(doc)]
        for i, j in zip(cuts, cuts[1:]):
            yield int(doc[i]), i, j


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, with all columns, whatever their names, and without a shuffle.

    Null and empty texts stay, as do all rows if the benchmark is empty; empty tables give no rows.
    """
    for block in blocks_of(benchmark):
        docs = docs.filter(~_leaks(docs.sparkSession.sparkContext.broadcast(Items(block)))(F.lower("text").cast("binary")))
    return docs


def _leaks(sent):
    @F.arrow_udf("boolean")
    def leaks(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for body in bodies:
            flags: list[bool] = []
            for _, n, found in _aligned(iter([pa.RecordBatch.from_arrays([body], names=["body"])]), 0, sent.value):
                hit = {d for d, _ in found}
                flags += [d in hit for d in range(n)]
            yield pa.array(flags, pa.bool_())

    return leaks


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
QUERIES = {"op8_decontaminate": op8_decontaminate}
