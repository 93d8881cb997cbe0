"""Quality rules by suffix-array repetition.

The words of all texts of a slice are interned to ids that no two texts share, so one suffix
array, made by prefix doubling, serves them all and nothing repeats across texts.  The longest
common prefixes of neighbours come from the irreducible ones, which are compared word by word
(at most 2 n log n words in all); each of the others is one less than its left neighbour's.

An interval of the suffix array whose prefixes agree on no fewer words than its ends do is a
repeated substring that cannot grow to the right; if the words before it differ it is maximal.
The union of all maximal repeats is that of each suffix's longest repeat, as a longest repeat
that is not maximal lies within the one that begins a word earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE_SEP, read, slices
from .runs import agreement, interned

#: Fixed by contract: words a text needs, words of a window, and the share of words in repeated windows that fails, in percent.
LEAST_WORDS, WINDOW, MOST_PERCENT = 50, 3, 50
#: The method's verdict: repeats of so many words count, may cover so many percent of the words, and be so many words long.
REPEAT_WORDS, REPEAT_PERCENT, LONGEST = 10, 30, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_repeats bigint, covered_words bigint, longest_repeat bigint"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_())] + [(c, pa.int64()) for c in ("n_repeats", "covered_words", "longest_repeat")])


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; ids are not negative.  Only suffixes that are not told apart yet are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank, slots, h = np.empty(n + 1, np.int64), np.arange(n), 1
    rank[n] = -1
    keys = ids[order]
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[order[slots]] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(slots) else slots
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        if not len(slots):
            return order
        at = order[slots]
        keys = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        turn = np.argsort(keys, kind="stable")
        order[slots], keys = at[turn], keys[turn]
        h *= 2


def neighbour_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[k] is the length of the common prefix of the suffixes at k - 1 and k; lcp[0] is 0."""
    n = len(ids)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    ends = np.concatenate([[-1], ids, [-2]])  # ends[i + 1] is ids[i]
    hard = (before <= 0) | (ends[np.arange(n)] != ends[before])
    plcp = np.zeros(n, np.int64)
    at = np.flatnonzero(hard & (before >= 0))
    k = 0
    while len(at) > 64 or (len(at) and k < 16):
        at = at[ends[at + k + 1] == ends[before[at] + k + 1]]
        k += 1
        plcp[at] = k
    for i in at.tolist():
        plcp[i] = agreement(ids[i:], ids[before[i] :], k)
    # a reducible value is that of the irreducible one to its left less the distance
    last = np.maximum.accumulate(np.where(hard, np.arange(n), 0))
    return (plcp[last] - (np.arange(n) - last))[order]


def maximal_repeats(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All maximal repeated substrings of `least` words or more as (first, last, length): the places in `order` where they occur."""
    fore = np.concatenate([[-1], ids])[order]  # the word before each suffix
    changes = np.cumsum(np.concatenate([[False], fore[1:] != fore[:-1]]))
    found, stack = [], []  # of (first, length), lengths rising
    where = np.flatnonzero(lcp >= least)
    for k, length, near in zip(where.tolist(), lcp[where].tolist(), (np.diff(where, append=-1) == 1).tolist()):
        first = k - 1
        while stack and stack[-1][1] > length:
            first, longer = stack.pop()
            found.append((first, k - 1, longer))
        if not stack or stack[-1][1] < length:
            stack.append((first, length))
        if not near:
            found += [(first, k, longer) for first, longer in stack]
            stack = []
    return [(a, b, length) for a, b, length in found if changes[b] > changes[a]]


def _covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of `least` words or more, given each suffix's longest repeat."""
    ends = np.where(best >= least, np.arange(len(best)) + best, 0)
    return np.maximum.accumulate(ends) > np.arange(len(best))


class Repetition(NamedTuple):
    windowed: np.ndarray  # words in windows of WINDOW words that are found twice or more
    covered: np.ndarray  # words in maximal repeats of REPEAT_WORDS or more
    best: np.ndarray  # the longest repeat at each word
    starts: np.ndarray  # of each maximal repeat, one place


def repetition(ids: np.ndarray) -> Repetition:
    """What repeats in sequences of which no two share an id."""
    order = suffix_array(ids)
    lcp = neighbour_prefixes(ids, order)
    best = np.zeros(len(ids), np.int64)
    best[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]])[: len(lcp)])
    repeats = maximal_repeats(ids, order, lcp, REPEAT_WORDS)
    window = np.where(best >= WINDOW, WINDOW, 0)
    return Repetition(_covered(window, WINDOW), _covered(best, REPEAT_WORDS), best, order[[a for a, _, _ in repeats]] if repeats else np.empty(0, np.int64))


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[bounds[1:]] - total[bounds[:-1]]


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: measures of the whole text and whether it is kept.

    A text fails if it has fewer than LEAST_WORDS words, if windows of three words found twice or
    more hold over half of its words, if maximal repeats of REPEAT_WORDS or more cover over
    REPEAT_PERCENT of its words, or if one is over LONGEST words long.  Null texts count as
    empty (all counts 0, not kept); null keys stay null; repeated rows are judged each; texts
    are read whole, a task holding some 250 bytes a word of its longest; empty tables give no
    rows; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, 1):
            raw, n = data.tobytes(), rows.num_rows
            bodies = [raw[offsets[i] : offsets[i + 1]] for i in range(n)]
            lines = [[line for line in body.split(b"\n") if line and not line.isspace()] for body in bodies]
            ids, bounds = interned([body.split() for body in bodies])
            rep = repetition(ids)
            words = np.diff(bounds)
            windowed, covered = _sums(rep.windowed, bounds), _sums(rep.covered, bounds)
            longest = np.array([rep.best[a:b].max(initial=0) for a, b in zip(bounds, bounds[1:])], np.int64)
            failed = (words < LEAST_WORDS) | (100 * windowed > MOST_PERCENT * words)
            kept = ~failed & (100 * covered <= REPEAT_PERCENT * words) & (longest <= LONGEST)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(words),
                    pa.array(_sums(~SPACE_SEP[data] & ((data & 0xC0) != 0x80), offsets)),
                    pa.array(_sums(_SYMBOL[data], offsets)),
                    pa.array([len(found) - len(set(found)) for found in lines], pa.int64()),
                    pa.array(windowed),
                    pa.array(failed),
                    pa.array(kept),
                    pa.array(np.diff(np.searchsorted(np.sort(rep.starts), bounds))),
                    pa.array(covered),
                    pa.array(longest),
                ],
                schema=_ARROW,
            )

    return docs.selectExpr(f"cast({key} as bigint) doc_id", f"cast({text} as binary) body").mapInArrow(run, SCHEMA)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op12_quality_rules": op12_quality_rules}
