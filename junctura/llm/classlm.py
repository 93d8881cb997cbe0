"""Language-model scores by Brown classes.

P(word | before) = P(class | class before) * P(word | class).  Every training word has a class:

1. The exchange algorithm moves the most frequent words, and endings of the others, between
   classes while the mutual information of neighbouring classes grows.
2. Every other word then makes the exchange's best move, from the counts of the classes that
   stand beside it in all training texts: a distributed step over the whole vocabulary.

The number of classes grows with the vocabulary.  Words that training has not seen have the
class of their ending and share one place in it.  All counts are over all training documents.

Frequent words' counts and classes, at most KNOWN_WORDS of them, are sent to executors; rarer
words meet theirs in an equi join, which has no hot key because frequent words take no part.
Rare words that stand together are brought together again by document, as each one's class
tells what the next one costs.  A word is named by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTE, SPACE_SEP, keep, mix64, read, slices, spans, stash, word_hashes

OWN_SYMBOLS = 1500
ENDINGS = 384
ROUNDS = 12
KNOWN_WORDS = 1 << 18
HELD_PAIRS = 1 << 20  # neighbour counts that a task combines before it sends them
ADD = 0.1
STEPS = 32
PULL = 4.0  # weight of the class's overall share in its transitions
STAY = 3.0  # what a word must gain, in nats, to leave the class of its ending
END = 0  # the end token's symbol and class


@dataclass
class Model:
    """What executors need to score texts; bounded by the constants above and the square of the classes."""

    words: np.ndarray  # hashes of known frequent words, sorted
    counts: np.ndarray
    classes: np.ndarray  # their classes
    total: int
    distinct: int
    end_count: int
    endings: np.ndarray  # class of unknown words by ending
    transitions: np.ndarray  # log10 P(class | class before)
    rest: np.ndarray  # log10 denominator of P(word | class); class 0 holds the end token alone


def classes_for(distinct: int) -> int:
    return 8 + round(2 * max(1, distinct) ** 0.25)


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: int = ENDINGS) -> np.ndarray:
    """A bucket by the last three bytes of each word."""
    key = np.zeros(len(starts), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        key = key * np.uint64(257) + np.where(at >= starts, LOWER_BYTE[data[np.maximum(at, 0)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix64(key) % np.uint64(symbols)).astype(np.int64)


def lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in a sorted table, or -1."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.searchsorted(table, hashes)
    at[at == len(table)] = 0
    return np.where(table[at] == hashes, at, -1)


def with_ends(values: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all documents, each followed by `end`, and where documents begin."""
    docs = len(first) - 1
    out = np.full(len(values) + docs, end, values.dtype)
    begin = first + np.arange(docs + 1)
    out[np.arange(len(values)) + np.repeat(np.arange(docs), np.diff(first))] = values
    return out, begin


def count_words(bodies: DataFrame) -> DataFrame:
    """(hash, ending, n) of all words; the end token is not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ends_ = [], []
            for _, data, offsets in slices(iter([batch]), 0):
                starts, ends, _ = spans(data, offsets, SPACE_SEP)
                hashes.append(word_hashes(data, starts, ends))
                ends_.append(endings(data, starts, ends))
            if hashes:
                h, at, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(ends_)[at].astype(np.int32)), pa.array(n)], names=["hash", "ending", "n"])

    return bodies.mapInArrow(run, "hash bigint, ending int, n bigint").groupBy("hash", "ending").agg(F.sum("n").alias("n"))


def count_pairs(bodies: DataFrame, own: np.ndarray) -> np.ndarray:
    """How often symbol follows symbol; END stands before and after each text."""
    size = 1 + len(own) + ENDINGS
    sent = bodies.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * size, np.int64)
        for _, data, offsets in slices(batches, 0):
            starts, ends, first = spans(data, offsets, SPACE_SEP)
            seq, _ = with_ends(symbols_of(lookup(sent.value, word_hashes(data, starts, ends)), endings(data, starts, ends), len(sent.value)), first, END)
            np.add.at(counts, END * size + seq[:1], 1)
            got, n = np.unique(seq[:-1] * size + seq[1:], return_counts=True)
            counts[got] += n
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["pair", "n"])

    got = bodies.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size * size rows
    out = np.zeros(size * size, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(size, size)


def symbols_of(own: np.ndarray, ending: np.ndarray, n_own: int) -> np.ndarray:
    return np.where(own >= 0, own + 1, ending + 1 + n_own)


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol.  Class 0 is the end token's alone."""
    size = len(pairs)
    classes = min(classes, size)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[(order != END) & (weight[order] > 0)]
    of = np.ones(size, np.int64) if classes > 1 else np.zeros(size, np.int64)
    of[END] = 0
    of[order] = 1 + np.arange(len(order)) % max(1, classes - 1)
    if classes < 3:
        return of
    p = pairs.astype(np.float64)
    onehot = np.eye(classes)[of]
    out, into = p @ onehot, p.T @ onehot  # symbol to class, class to symbol
    m = onehot.T @ out
    log = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(rounds):
        moved = 0
        for s in order.tolist():
            a, self_ = of[s], p[s, s]
            o, i = out[s].copy(), into[s].copy()
            # without s: its own class loses what s gives and takes
            m[a, :] -= o
            m[:, a] -= i
            m[a, a] += self_
            o[a] -= self_
            i[a] -= self_
            rows, cols = m.sum(1), m.sum(0)
            lm = log(m)
            # what each class gains by taking s
            some, other = np.flatnonzero(o), np.flatnonzero(i)
            gain = (log(m[:, some] + o[some]) - lm[:, some]).sum(1) + (log(m[other] + i[other, None]) - lm[other]).sum(0)
            d = np.arange(classes)
            gain += log(m[d, d] + o + i + self_) - log(m[d, d] + o) - log(m[d, d] + i) + lm[d, d]
            gain -= log(rows + o.sum() + self_) - log(rows) + log(cols + i.sum() + self_) - log(cols)
            # s changes the sums of the classes around it in the same way wherever it goes
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            m[b, :] += o
            m[:, b] += i
            m[b, b] += self_
            if b != a:
                moved += 1
                of[s] = b
                out[:, a] -= p[:, s]
                out[:, b] += p[:, s]
                into[:, a] -= p[s, :]
                into[:, b] += p[s, :]
        if moved <= len(order) // 200:
            break
    return of


def frequent_from(vocabulary: DataFrame, most: int | None = None) -> float:
    """The least count such that no more than `most` words have it, on a scale of STEPS a doubling.

    The histogram has some thousand rows at any size, so words are not sorted.
    """
    most = KNOWN_WORDS if most is None else most
    histogram = vocabulary.groupBy(F.floor(F.log2("n") * STEPS).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
    least, words = float("inf"), 0
    for step in histogram:
        words += step.words
        if words > most:
            break
        least = step.least
    return least


_BESIDE = pa.schema([("hash", pa.int64()), ("old", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])


def beside(bodies: DataFrame, own: np.ndarray, of: np.ndarray) -> DataFrame:
    """(hash, old, code, n): how often two classes stand around each word that is not its own symbol.

    old is the class of the word's ending.  With C classes, code is 2 C times the class before
    and the class after, plus C where what follows is not its own symbol either.
    """
    sent = bodies.sparkSession.sparkContext.broadcast((own, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = sent.value
        n_class, held, rows = int(of.max()) + 1, [], 0

        def combined() -> pa.RecordBatch:
            h, key, n = (np.concatenate([part[k] for part in held]) for k in range(3))
            order = np.lexsort((key, h))
            h, key, n = h[order], key[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]))))
            h, key, n = h[new], key[new], np.add.reduceat(n, new)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((key // (2 * n_class**2)).astype(np.int32)), pa.array((key % (2 * n_class**2)).astype(np.int32)), pa.array(n)], schema=_BESIDE)

        for _, data, offsets in slices(batches, 0):
            starts, ends, first = spans(data, offsets, SPACE_SEP)
            hashes = word_hashes(data, starts, ends)
            symbols, _ = with_ends(symbols_of(lookup(own, hashes), endings(data, starts, ends), len(own)), first, END)
            words, _ = with_ends(hashes, first, 0)
            cls = of[symbols]
            at = np.flatnonzero(symbols > len(own))
            if not len(at):
                continue
            after = cls[at + 1] + np.where(symbols[at + 1] > len(own), n_class, 0)
            key = (cls[at] * n_class + np.where(at > 0, cls[at - 1], END)) * 2 * n_class + after
            held.append((words[at], key, np.ones(len(key), np.int64)))
            rows += len(key)
            if rows > HELD_PAIRS:
                yield combined()
                rows = 0
        if held:
            yield combined()

    return bodies.mapInArrow(run, "hash bigint, old int, code int, n bigint")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut where it changes."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = table.column(0).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def best_classes(rows: DataFrame, transitions: np.ndarray, sizes: np.ndarray) -> DataFrame:
    """(hash, cls, n) of each word of `beside`, and rows with a null hash that count n moves, numbered by cls, between classes.

    A word goes where its neighbours are likeliest and words are fewest: the exchange's best move
    while all others stay.
    """
    sent = rows.sparkSession.sparkContext.broadcast((np.log(10) * transitions, np.log(np.maximum(sizes, 1.0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, size = sent.value
        n_class = len(size)
        moves = np.zeros(n_class * n_class, np.int64)
        for table in whole_groups(batches):
            h, old, code, n = (table.column(k).to_numpy() for k in range(4))
            before, after = code // (2 * n_class), code % (2 * n_class)
            beyond = after < n_class  # what follows is its own symbol, so the pair is not counted from there
            after = after % n_class
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            total, word = np.add.reduceat(n, new), np.repeat(np.arange(len(new)), np.diff(np.append(new, len(h))))
            chosen = np.empty(len(new), np.int64)
            for i in range(0, len(new), 2048):
                j = min(i + 2048, len(new))
                lo, hi = new[i], new[j] if j < len(new) else len(h)
                at, size_ = (word[lo:hi] - i) * n_class, (j - i) * n_class
                counts = [np.bincount(at + side[lo:hi], n[lo:hi], size_).reshape(-1, n_class) for side in (before, after)]
                gain = counts[0] @ logs + counts[1] @ logs.T - total[i:j, None] * size
                gain[:, END] = -np.inf
                gain[np.arange(j - i), old[new[i:j]]] += STAY
                chosen[i:j] = gain.argmax(1)
            each = chosen[word]
            moves += np.bincount(before * n_class + each, n, len(moves)).astype(np.int64)
            moves += np.bincount((each * n_class + after)[beyond], n[beyond], len(moves)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(chosen.astype(np.int32)), pa.array(total)], names=["hash", "cls", "n"])
        found = np.flatnonzero(moves)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.array(found.astype(np.int32)), pa.array(moves[found])], names=["hash", "cls", "n"])

    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "hash bigint, cls int, n bigint")


def log_transitions(m: np.ndarray) -> np.ndarray:
    share = (m.sum(0) + 0.5) / (m.sum() + 0.5 * len(m))
    return np.log10((m + PULL * share) / (m.sum(1, keepdims=True) + PULL))


def train(bodies: DataFrame, end_count: int) -> tuple[Model, DataFrame]:
    """The model, and the counts and classes of training words that it does not hold, as (hash, cls, n)."""
    vocabulary = keep(count_words(bodies))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = frequent_from(vocabulary)
    top = vocabulary.filter(F.col("n") >= max(least, frequent_from(vocabulary, OWN_SYMBOLS))).toArrow()  # at most OWN_SYMBOLS rows
    order = np.argsort(top.column(0).to_numpy().view(np.uint64))
    own, own_counts = top.column(0).to_numpy().view(np.uint64)[order], top.column(2).to_numpy()[order]
    vocabulary.unpersist()
    pairs = count_pairs(bodies, own)
    of = np.unique(exchange(pairs, classes_for(distinct)), return_inverse=True)[1]  # without classes that nothing is left in
    onehot = np.eye(of.max() + 1)[of]
    n_class = onehot.shape[1]
    m = onehot.T @ pairs @ onehot
    others = stash(best_classes(beside(bodies, own, of), log_transitions(m), m.sum(0)), "classes")
    words = others.filter("hash is not null")
    # transitions between own symbols as counted, all others with the classes chosen
    core = np.zeros(len(pairs), bool)
    core[: len(own) + 1] = True
    m = onehot[core].T @ pairs[np.ix_(core, core)] @ onehot[core]
    for r in others.filter("hash is null").groupBy("cls").agg(F.sum("n").alias("n")).collect():  # at most a row a pair of classes
        m[r.cls // n_class, r.cls % n_class] += r.n
    own_class = of[1 : len(own) + 1]
    tokens, types = np.bincount(own_class, own_counts, n_class), np.bincount(own_class, minlength=n_class).astype(float)
    for r in words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row a class
        tokens[r.cls], types[r.cls] = tokens[r.cls] + r.n, types[r.cls] + r.v
    known = words.filter(F.col("n") >= least).toArrow()  # at most KNOWN_WORDS rows
    every = np.concatenate((own, known.column(0).to_numpy().view(np.uint64)))
    order = np.argsort(every)
    counts, classes = np.concatenate((own_counts, known.column(2).to_numpy())), np.concatenate((own_class, known.column(1).to_numpy()))
    model = Model(every[order], counts[order], classes[order].astype(np.int64), int(total) + end_count, int(distinct) + (end_count > 0), end_count, of[len(own) + 1 :], log_transitions(m), np.log10(tokens + ADD * (types + 1)))
    return model, words.filter(F.col("n") < least)


_PARTS = "doc_id bigint, uid bigint, run bigint, idx bigint, n_tokens bigint, n_known bigint, base double, model double, hash bigint, before int, after int, other int, times bigint"
_PARTS_ARROW = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("run", pa.int64()), ("idx", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("hash", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("other", pa.int32()), ("times", pa.int64())])


def score_parts(bodies: DataFrame, model: Model) -> DataFrame:
    """A row for each document, run -1, with what frequent words give, and rows for its rarer words.

    A rare word has the classes before and after it, -1 where that is a rare word too, and the
    class of its ending for the case that training has not seen it.  Rare words in a row have the
    same run; single ones between the same classes are one row with their number.
    """
    sent = bodies.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mo = sent.value
        denominator = np.log10(mo.total + ADD * (mo.distinct + 1)) if mo.total else 0.0
        known_logs, end_log = np.log10(mo.counts + ADD), np.log10(mo.end_count + ADD)
        word_logs = known_logs - mo.rest[mo.classes]
        for rows, data, offsets in slices(batches, 1):
            starts, ends, first = spans(data, offsets, SPACE_SEP)
            hashes = word_hashes(data, starts, ends)
            at = lookup(mo.words, hashes)
            docs, known = len(first) - 1, at >= 0
            of_word = np.repeat(np.arange(docs), np.diff(first))
            cls, begin = with_ends(np.where(known, mo.classes[at], -1) if len(mo.words) else np.full(len(at), -1), first, END)
            before = np.concatenate(([END], cls[:-1]))
            both = (cls >= 0) & (before >= 0)
            logs = np.where(both, mo.transitions[before, cls], 0.0)
            count_log = np.where(known, known_logs[at], 0.0) if len(mo.words) else np.zeros(len(at))
            base = np.bincount(of_word, count_log, docs) + end_log - denominator * (np.diff(first) + 1)
            score = np.add.reduceat(logs, begin[:-1]) + (np.bincount(of_word[known], word_logs[at[known]], docs) if len(mo.words) else 0.0)
            n_known = np.bincount(of_word, known, docs).astype(np.int64) + (mo.end_count > 0)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            id_bits = np.nan_to_num(ids.astype(np.float64)).astype(np.int64) if rows.column(0).null_count else ids
            text = np.zeros(docs, np.uint64)
            np.add.at(text, of_word, mix64(hashes + np.arange(len(hashes), dtype=np.uint64) - first[of_word].astype(np.uint64)))
            uid = mix64(text ^ id_bits.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            none, small = np.zeros(docs, np.int64), np.zeros(docs, np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, (uid, none - 1, none, np.diff(first) + 1, n_known, base, score, uid, small, small, small, none))], schema=_PARTS_ARROW)
            rare = np.flatnonzero(~known)
            if not len(rare):
                continue
            d = of_word[rare]
            place = rare + d  # in the sequence with ends
            left, right = before[place], cls[place + 1]
            other = mo.endings[endings(data, starts[rare], ends[rare])]
            single = (left >= 0) & (right >= 0)
            by = np.lexsort((right, left, hashes[rare], d, ~single))
            d, place, left, right, other, single, h = (x[by] for x in (d, place, left, right, other, single, hashes[rare]))
            same = np.concatenate(([False], single[1:] & single[:-1] & (d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1])))
            new = np.flatnonzero(~same)
            times = np.diff(np.append(new, len(d)))
            d, place, left, right, other, single, h = (x[new] for x in (d, place, left, right, other, single, h))
            # within a run of several, places follow each other: sorted by place, a run begins where a known class stands before
            order = np.argsort(place, kind="stable")
            d, place, left, right, other, h, times = (x[order] for x in (d, place, left, right, other, h, times))
            head = np.maximum.accumulate(np.where(left >= 0, place, 0))
            none = np.zeros(len(d), np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(d)), *map(pa.array, (uid[d], head - begin[d], place - head, none, none, none.astype(np.float64), none.astype(np.float64), h.view(np.int64), left.astype(np.int32), right.astype(np.int32), other.astype(np.int32), times))], schema=_PARTS_ARROW)

    return bodies.mapInArrow(run, _PARTS)


_SCORES = "doc_id bigint, rows bigint, n_tokens bigint, n_known bigint, base double, model double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("rows", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])


def summed(parts: DataFrame, model: Model) -> DataFrame:
    """A row for each document and the number of equal ones, from its parts with `cls` and `n` of their words, null where unknown."""
    sent = parts.sparkSession.sparkContext.broadcast((model.transitions, model.rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, rest = sent.value
        for table in whole_groups(batches):
            uid, run_, idx, times = (table.column(c).to_numpy() for c in ("uid", "run", "idx", "times"))
            again = np.concatenate(([False], (uid[1:] == uid[:-1]) & (run_[1:] == run_[:-1]) & (idx[1:] == idx[:-1])))
            doc = run_ == -1
            new = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1])))
            rows = np.add.reduceat(doc.astype(np.int64), new)
            keep_ = np.flatnonzero(~again)  # equal documents have their parts once
            part = table.take(pa.array(keep_))
            uid, run_, idx, times, doc = uid[keep_], run_[keep_], idx[keep_], times[keep_], doc[keep_]
            n = part.column("n").fill_null(0).to_numpy()
            c = np.where(part.column("cls").is_null().to_numpy(), part.column("other").to_numpy(), part.column("cls").fill_null(0).to_numpy())
            left, right = part.column("before").to_numpy(), part.column("after").to_numpy()
            follows = np.concatenate(([False], (uid[1:] == uid[:-1]) & (run_[1:] == run_[:-1]) & (idx[1:] == idx[:-1] + 1) & ~doc[1:]))
            step = np.where(left >= 0, moves[left, c], np.where(follows, moves[np.roll(c, 1), c], 0.0)) + np.where(right >= 0, moves[c, right], 0.0)
            count_log = np.log10(n + ADD)
            start = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1])))
            total = lambda x: np.add.reduceat(x, start)  # noqa: B023, E731
            of = lambda name: part.column(name).to_numpy()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(start)).combine_chunks(), pa.array(rows), pa.array(total(of("n_tokens"))), pa.array(total(of("n_known") + np.where(n > 0, times, 0))),
                pa.array(total(of("base") + np.where(doc, 0.0, times * count_log))), pa.array(total(of("model") + np.where(doc, 0.0, times * (count_log - rest[c] + step)))),
            ], schema=_SCORES_ARROW)

    return parts.repartition("uid").sortWithinPartitions("uid", "run", "idx").mapInArrow(run, _SCORES)


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: tokens, known tokens, the unigram base, the class model and its perplexity.

    Learns from the rows where `held_out` is not true.  Null and empty texts are one end token;
    texts are read whole, however long; rows that repeat key and text are returned as often; null
    keys stay null; without training rows every token is unknown.  Empty tables give no rows;
    other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("body"), F.coalesce(held_out, F.lit(False)).alias("held"))
    training = rows.filter(~F.col("held")).select("body")
    model, rare = train(training, training.count())
    parts = score_parts(rows.select("doc_id", "body"), model)
    parts = parts.join(rare.withColumnRenamed("hash", "v_hash"), F.col("hash") == F.col("v_hash"), "left").drop("v_hash", "hash")
    found = summed(parts.select("uid", *(c for c in parts.columns if c != "uid")), model)
    return found.select(
        F.col("doc_id").alias(key), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"),
        F.pow(F.lit(10.0), -F.col("model") / F.col("n_tokens")).alias("perplexity"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"),
    ).drop("copy")


def fold(key: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 10) == 0
    scored = score_texts(read(spark, sf_dir, "documents"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


SQL: dict[str, str] = {}
QUERIES = {"op5_class_lm": op5_class_lm}
