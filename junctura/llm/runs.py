"""Periodic runs of words by Main-Lorentz divide and conquer.

A text's words are interned to ids.  A segment is halved again and again; at each midpoint two
Z-functions, of the right half and of the reversed left half, show every period whose square
begins there.  As a run has four periods or more, one of its sides of the midpoint holds two.
What is found is extended over the other half; of equal intervals the smallest period stays.

All segments of a level, of all texts of a slice, are looked through at once: only those whose
midpoint can begin a square get Z-functions.  A run belongs to the largest segment that holds
it whole across its midpoint, so a segment drops what goes on beyond its ends.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, slices

#: Fixed by contract: a run's least length in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint, n_dropped bigint"
_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64()), ("n_dropped", pa.int64())])


def interned(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, no id in two texts, and where each text begins (one more entry)."""
    ids = np.empty(sum(map(len, texts)), np.int64)
    bounds = np.zeros(len(texts) + 1, np.int64)
    used = at = 0
    for k, words in enumerate(texts):
        known: dict[bytes, int] = {}
        new = known.setdefault
        ids[at : at + len(words)] = [new(w, len(known)) for w in words]
        ids[at : at + len(words)] += used
        used += len(known)
        at += len(words)
        bounds[k + 1] = at
    return ids, bounds


def agreement(x: np.ndarray, y: np.ndarray, known: int = 0) -> int:
    """Length of the longest common prefix, of which `known` words are known to agree."""
    n, step = min(len(x), len(y)), 16
    while known < n:
        differ = x[known : min(n, known + step)] != y[known : min(n, known + step)]
        first = int(differ.argmax())
        if differ[first]:
            return known + first
        known += len(differ)
        step = min(2 * step, 1 << 16)
    return known


def z_function(x: np.ndarray) -> np.ndarray:
    """z[q] is the length of the longest common prefix of x and x[q:]; linear time.

    Inside a box x[q:r] == x[:r-q] all values up to the first that reaches r are copied at once.
    """
    n = len(x)
    z = np.zeros(n, np.int64)
    if not n:
        return z
    z[0] = n
    hits = np.flatnonzero(x[1:] == x[0]) + 1
    h, q, known = 0, int(hits[0]) if len(hits) else n, 0
    while q < n:
        z[q] = agreement(x, x[q:], known)
        r, known = q + int(z[q]), 0
        at = q + 1
        while at < r:
            upto = min(r, at + 4096)
            left = r - np.arange(at, upto)
            copied = z[(np.arange(at, upto) - q - 1) % q + 1]
            meets = np.flatnonzero(copied == left) if r < n else ()
            end = at + int(meets[0]) if len(meets) else upto
            z[at:end] = np.minimum(copied, left)[: end - at]
            at = end
            if len(meets):
                known = r - at
                break
        if known:
            q = at
        else:
            h += int(np.searchsorted(hits[h:], r if r > q else q + 1))
            q = int(hits[h]) if h < len(hits) else n
    return z


def squares(z: np.ndarray) -> Iterator[tuple[int, int]]:
    """Periods of the squares that a sequence begins with, and how far each period goes.

    Where period q holds over e words, a period of at most e / 2 is a multiple of a smaller one.
    """
    reach = len(z) // 2
    good = np.flatnonzero(z[1 : reach + 1] >= np.arange(1, reach + 1)) + 1
    k = 0
    while k < len(good):
        q = int(good[k])
        extent = q + int(z[q])
        yield q, extent
        k = int(np.searchsorted(good, extent // 2, "right"))


def _promising(ids: np.ndarray, anchor: np.ndarray, half: np.ndarray, way: int) -> np.ndarray:
    """Which anchors may begin a square of at most `half` words, read in direction `way`."""
    reach = half // 2
    seg = np.repeat(np.arange(len(anchor)), reach)
    q = np.arange(1, len(seg) + 1) - np.repeat(np.cumsum(reach) - reach, reach)
    here = ids[anchor]
    hit = ids[anchor[seg] + way * q] == here[seg]
    seg, q = seg[hit], q[hit]
    for i in (1, 2, 3, None):
        j = q - 1 if i is None else np.minimum(i, q - 1)
        a = anchor[seg]
        hit = ids[a + way * (q + j)] == ids[a + way * j]
        seg, q = seg[hit], q[hit]
    found = np.zeros(len(anchor), bool)
    found[seg] = True
    return found


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) in the sequences that `bounds` parts, in order of start and period.

    No id may be in two sequences.
    """
    found: dict[tuple[int, int], int] = {}
    solid = np.zeros(len(ids), np.int64)  # the run of a period of at most 3 that a word is in
    ends = np.concatenate([[-1], ids, [-2]])  # ends[i + 1] is ids[i]
    lo, hi = bounds[:-1], bounds[1:]
    while True:
        wide = hi - lo >= LEAST_WORDS
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            break
        # nothing but the run itself is in a segment inside a run of such a period
        open_ = (solid[lo] != solid[hi - 1]) | (solid[lo] == 0)
        lo, hi = lo[open_], hi[open_]
        mid = (lo + hi) // 2
        for way, look in ((1, _promising(ids, mid, hi - mid, 1)), (-1, _promising(ids, mid - 1, mid - lo, -1))):
            for a, m, b in zip(lo[look].tolist(), mid[look].tolist(), hi[look].tolist()):
                for q, extent in squares(z_function(ids[m:b] if way > 0 else ids[a:m][::-1])):
                    if way > 0:
                        s, e = m - agreement(ids[a:m][::-1], ids[a + q : m + q][::-1]), m + extent
                    else:
                        s, e = m - extent, m + agreement(ids[m:b], ids[m - q : b - q])
                    whole = (s > a or ends[s] != ends[s + q]) and (e < b or ends[e + 1] != ends[e + 1 - q])
                    if whole and e - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
                        found[s, e] = min(q, found.get((s, e), q))
                        if q <= 3:
                            solid[s:e] = len(found)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc: int | None) -> list[bytes]:
    """The contract's tenth of the texts, by id, with a periodic tail; rows without an id are left as they are."""
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def word_runs(docs: DataFrame, rewrite=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: its runs, the longest of them, and the text without the repeats.

    A word that stands in a run behind the run's first period is dropped.  `rewrite(words, id)`
    may change the words beforehand.  Null texts count as empty (no runs, hashes of nothing);
    null keys stay null; repeated rows are read each; texts are read whole, a task holding some
    120 bytes a word of its longest; empty tables give no rows; other columns, whatever their
    names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, 1):
            raw, keys = data.tobytes(), rows.column(0).to_pylist()
            texts = [raw[offsets[i] : offsets[i + 1]].split() for i in range(len(keys))]
            if rewrite:
                texts = [rewrite(words, k) for words, k in zip(texts, keys)]
            ids, bounds = interned(texts)
            runs = find_runs(ids, bounds)
            first = np.searchsorted([s for s, _, _ in runs], bounds)
            out = []
            for i, (k, words) in enumerate(zip(keys, texts)):
                base = int(bounds[i])
                mine = [(s - base, e - s, q) for s, e, q in runs[first[i] : first[i + 1]]]
                kept = np.ones(len(words), bool)
                for s, length, q in mine:
                    kept[s + q : s + length] = False
                best = min(mine, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                told = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in mine).encode()).hexdigest()
                rest = hashlib.sha256(b" ".join(compress(words, kept.tolist()) if mine else words)).hexdigest()
                out.append((k, len(mine), *best, None if not mine else 1000 * best[1] // best[2], told, rest, len(words), int(len(words) - kept.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)

    return docs.selectExpr(f"cast({key} as bigint) doc_id", f"cast({text} as binary) body").mapInArrow(run, SCHEMA)


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs(read(spark, sf_dir, "documents"), planted)


SQL: dict[str, str] = {}
QUERIES = {"op11_word_runs": op11_word_runs}
