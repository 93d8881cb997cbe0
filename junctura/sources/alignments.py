"""Aligned reads from SAM text and BAM files.

BAM is a Python data source: `spark.read.format("bam").load(paths)`.  A file is cut into splits of
some 64 MB of BGZF blocks; a split owns the records that begin in its blocks and finds the first
one by its form.  With a filter on chrom, which is pushed to the reader, and an index beside the
file only the chromosomes' blocks are read, from exact places.  Fixed fields are decoded with
NumPy, sequences and qualities are skipped.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import cigar as C
from ..operators.reads import EXCLUDED_FLAGS, JUNCTION, READS, REVERSE

_ARROW = pa.schema([("sample_idx", pa.int32()), ("qname", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("nh", pa.int32()), ("as_score", pa.int32())])
_OPS = "MIDNSHP=X"
_LETTERS = np.frombuffer((_OPS + "?").encode(), np.uint8)
#: Bytes of a tag's value by its kind, 0 for texts, arrays and kinds that are not known, and which kinds are whole numbers.
_SIZES = np.zeros(256, np.int64)
_WHOLE = np.zeros(256, bool)
for _kinds, _bytes in (("AcC", 1), ("sS", 2), ("iIf", 4)):
    _SIZES[[ord(c) for c in _kinds]] = _bytes
    _WHOLE[[ord(c) for c in _kinds if c in "cCsSiI"]] = True
NONE = -(1 << 40)
COUNTS = "chrom string, start bigint, end bigint, strand string, sample_idx int, counts bigint, mapq_sum double, mapq_sq_sum double, nh_sum double, n bigint, max_anchor bigint"
_COUNTS = [c.split()[0] for c in COUNTS.split(", ")]
SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 8 << 20
READ_BYTES = 1 << 22  # compressed, at a time
CHAIN = 8  # records in a row that must look like records where a split begins
NEAR_BYTES = 1 << 16  # chunks that lie no farther apart are read in one go
PSEUDO_BIN = 37450  # of an index: figures, not places


def read_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SAM text as reads; sample_idx is the place in `paths`."""
    names = spark.createDataFrame(list(enumerate(paths)), "sample_idx int, path string")
    lines = spark.read.text(paths).select("value", F.regexp_replace(F.input_file_name(), r"^file:/*", "/").alias("path"))
    names = names.withColumn("path", F.regexp_replace("path", r"^file:/*", "/"))
    f = F.split("value", "\t")
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:i:(-?\d+)", 1).try_cast("int")
    rows = lines.filter(~F.col("value").startswith("@") & (F.size(f) >= 11)).join(F.broadcast(names), "path")
    return rows.select("sample_idx", F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.nullif(F.get(f, F.lit(2)), F.lit("*")).alias("chrom"), (F.get(f, F.lit(3)).cast("bigint") - 1).alias("pos"), F.get(f, F.lit(4)).cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"), tag("NH").alias("nh"), tag("AS").alias("as_score"))


def _inflate(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Content of a series of gzip members, as BGZF is."""
    z, left = zlib.decompressobj(31), b""
    while data := left or stream.read(chunk):
        out = z.decompress(data)
        left = z.unused_data
        if z.eof:
            z = zlib.decompressobj(31)
        if out:
            yield out


class _Bytes:
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buffer, self.at, self.taken = parts, b"", 0, 0

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            more = next(self.parts, None)
            if more is None:
                return b""
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        out = self.buffer[self.at : self.at + n]
        self.at, self.taken = self.at + n, self.taken + n
        return out


def references(source: _Bytes) -> list[tuple[str, int]]:
    """Reference names and lengths, in order."""
    if source.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    source.take(struct.unpack("<i", source.take(4))[0])
    found = []
    for _ in range(struct.unpack("<i", source.take(4))[0]):
        name = source.take(struct.unpack("<i", source.take(4))[0])[:-1].decode()
        found.append((name, struct.unpack("<i", source.take(4))[0]))
    return found


def header(source: _Bytes) -> list[str]:
    """Reference names, in order."""
    return [name for name, _ in references(source)]


def _block_size(data: bytes, at: int) -> tuple[int, int] | None:
    """Size of the BGZF block that begins here and of its header, or None."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    p, end = at + 12, min(at + 12 + extra, len(data))
    while p + 4 <= end:
        size = struct.unpack_from("<H", data, p + 2)[0]
        if data[p : p + 2] == b"BC" and size == 2 and p + 6 <= end:
            return struct.unpack_from("<H", data, p + 4)[0] + 1, 12 + extra
        p += 4 + size
    return None


def is_blocked(stream) -> bool:
    stream.seek(0)
    return _block_size(stream.read(1 << 16), 0) is not None


def first_block(stream, at: int) -> int | None:
    """Place of the first BGZF block that begins at `at` or later; the next one must follow it."""
    stream.seek(at)
    data = stream.read(1 << 18)
    p = data.find(b"\x1f\x8b\x08\x04")
    while p >= 0:
        got = _block_size(data, p)
        if got and (p + got[0] >= len(data) or _block_size(data, p + got[0])):
            return at + p
        p = data.find(b"\x1f\x8b\x08\x04", p + 1)
    return None


def blocks(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """Places and contents of the BGZF blocks from `at` on."""
    stream.seek(at)
    data, p = b"", 0
    while True:
        if len(data) - p < 1 << 16:
            data, p = data[p:] + stream.read(READ_BYTES), 0
        if p >= len(data):
            return
        got = _block_size(data, p)
        if got is None or p + got[0] > len(data):
            raise ValueError(f"no BGZF block at {at}")
        yield at, zlib.decompress(data[p + got[1] : p + got[0] - 8], -15)
        p, at = p + got[0], at + got[0]


def _is_record(data: bytes, at: int, lengths: list[int]) -> int | None:
    """The end of what looks like a record at `at`, or None."""
    if at + 36 > len(data):
        return None
    size, tid, pos, low, high, n_seq, next_tid, next_pos = struct.unpack_from("<iiiIIiii", data, at)
    n_name, n_cigar = low & 0xFF, high & 0xFFFF
    least = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    if n_name < 1 or n_seq < 0 or not least <= size < 1 << 27 or not -1 <= tid < len(lengths) or not -1 <= next_tid < len(lengths):
        return None
    if pos < -1 or next_pos < -1 or (tid >= 0 and pos > lengths[tid]) or (next_tid >= 0 and next_pos > lengths[next_tid]):
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(data: bytes, limit: int, lengths: list[int]) -> int | None:
    """The first place before `limit` from which CHAIN records follow each other, or as many as there are."""
    for at in range(limit):
        p: int | None = at
        for _ in range(CHAIN):
            p = _is_record(data, p, lengths)
            if p is None or p + 36 > len(data):
                break
        if p is not None:
            return at
    return None


def split_records(source: Iterator[tuple[int, bytes]], start: int | None, end: tuple[int, int], lengths: list[int]) -> Iterator[tuple[bytes, list[int]]]:
    """Contents, and the places of whole records in them, of (place, content) of blocks.

    `start` is the place of the first record in the contents, found where it is not known; records
    that begin at `end`, a place of a block and one within it, or behind are left out.
    """
    data, base, total, at, limit, done = b"", 0, 0, start, None, False
    while not done:
        got, want = [data], total + (CHUNK_BYTES if at is not None else max(CHUNK_BYTES, 1 << 20))
        for place, content in source:
            if limit is None and place >= end[0]:
                limit = total + (end[1] if place == end[0] else 0)
            got.append(content)
            total += len(content)
            if total >= want or (limit is not None and at is not None and total >= limit + (1 << 16)):
                break
        else:
            done = True
        data = b"".join(got)
        stop = min(total, total if limit is None else limit)
        if at is None:
            at = first_record(data, stop, lengths)
            if at is None:
                if limit is not None:
                    return
                continue
        begins, p, n = [], at - base, len(data)
        while p + base < stop and p + 4 <= n:
            after = p + 4 + int.from_bytes(data[p : p + 4], "little")
            if after > n:
                break
            begins.append(p)
            p = after
        if begins:
            yield data, begins
        at = base + p
        if limit is not None and at >= limit:
            return
        data, base = data[p:], at


class Fields(NamedTuple):
    """Fixed fields of records and where their parts are in the content."""

    tid: np.ndarray
    pos: np.ndarray
    mapq: np.ndarray
    flag: np.ndarray
    name: np.ndarray  # places: of the name, of CIGAR words, of tags, and the end
    cigar: np.ndarray
    n_cigar: np.ndarray
    tags: np.ndarray
    end: np.ndarray

    def of(self, kept: np.ndarray) -> Fields:
        return Fields(*(x[kept] for x in self))


def fields(data: bytes, begins: list[int]) -> Fields:
    at = np.array(begins, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(36)].copy().view("<i4").astype(np.int64)
    low, high, n_seq = raw[:, 3] & 0xFFFFFFFF, raw[:, 4] & 0xFFFFFFFF, raw[:, 5]
    cigar, n_cigar = at + 36 + (low & 0xFF), high & 0xFFFF
    return Fields(raw[:, 1], raw[:, 2], low >> 8 & 0xFF, high >> 16, at + 36, cigar, n_cigar, cigar + 4 * n_cigar + (n_seq + 1) // 2 + n_seq, at + 4 + raw[:, 0])


def _pieces(data: bytes, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Stretches of bytes, in order and apart, as an array: they and the gaps between share one buffer, the gaps are left out."""
    places = np.stack([starts, ends], 1).ravel().astype(np.int32)
    if not len(places):
        return pa.array([], kind)
    both = pa.Array.from_buffers(kind, len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)])
    return both.take(pa.array(np.arange(0, len(places) - 1, 2)))


def cigar_words(data: bytes, starts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, operation as a letter, length) of all operations of records, in order."""
    row = np.repeat(np.arange(len(starts)), number)
    at = np.repeat(starts - 4 * (np.cumsum(number) - number), number) + 4 * np.arange(len(row))
    words = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.int64)
    return row, _LETTERS[np.minimum(words & 15, len(_OPS))], words >> 4


def _cigars(data: bytes, rec: Fields) -> pa.Array:
    """CIGAR strings, "*" without operations; each distinct one is written once."""
    found = _pieces(data, rec.cigar, rec.cigar + 4 * rec.n_cigar, pa.binary()).dictionary_encode()
    words = found.dictionary
    offs = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = words.buffers()[2].to_pybytes() if len(words) and words.buffers()[2] is not None else b""
    _, op, size = cigar_words(raw, offs[:-1], np.diff(offs) // 4)
    letters = pa.Array.from_buffers(pa.string(), len(op), [None, pa.py_buffer(np.arange(len(op) + 1, dtype=np.int32)), pa.py_buffer(op.tobytes())])
    parts = pc.binary_join_element_wise(pa.array(size).cast(pa.string()), letters, "")
    told = pc.binary_join(pa.ListArray.from_arrays(pa.array((offs // 4).astype(np.int32)), parts), "")
    return pc.if_else(pc.equal(told, ""), "*", told).take(found.indices)


def tag_values(data: bytes, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NH and AS of records, NONE where they are missing: the tags of all records are gone through side by side."""
    raw = np.frombuffer(data, np.uint8)
    nul = np.flatnonzero(raw == 0)
    out = {name: np.full(len(at), NONE, np.int64) for name in (b"NH", b"AS")}
    row, at = np.arange(len(at)), at.copy()
    whole = lambda p, n: sum(raw[np.minimum(p + k, len(raw) - 1)].astype(np.int64) << 8 * k for k in range(n))
    while True:
        left = at + 3 <= end[row]
        row, at = row[left], at[left]
        if not len(row):
            return out[b"NH"], out[b"AS"]
        kind, value = raw[at + 2], at + 3
        size = _SIZES[kind]
        for name, found in out.items():
            mine = np.flatnonzero((raw[at] == name[0]) & (raw[at + 1] == name[1]) & _WHOLE[kind])
            if len(mine):
                bits, k = whole(value[mine], 4), kind[mine]
                width = 8 * _SIZES[k]
                bits &= (1 << width) - 1
                signed = (k >= 97) & (bits >> (width - 1) > 0)
                found[row[mine]] = np.where(signed, bits - (1 << width), bits)
        text, many = (kind == 90) | (kind == 72), kind == 66
        step = size.copy()
        if text.any():
            stop = np.searchsorted(nul, value[text])
            step[text] = np.where(stop < len(nul), nul[np.minimum(stop, len(nul) - 1)], len(raw)) + 1 - value[text]
        if many.any():
            step[many] = 5 + _SIZES[raw[np.minimum(value[many], len(raw) - 1)]] * whole(value[many] + 1, 4)
        at = np.where((step > 0) | text | many, value + step, end[row])  # behind a tag of no known kind nothing can be read


def _tag_columns(data: bytes, rec: Fields) -> tuple[pa.Array, pa.Array]:
    found = _pieces(data, rec.tags, rec.end, pa.binary()).dictionary_encode()
    told = found.dictionary
    offs = np.frombuffer(told.buffers()[1], np.int32, len(told) + 1, told.offset * 4).astype(np.int64) if len(told) else np.zeros(1, np.int64)
    raw = told.buffers()[2].to_pybytes() if len(told) and told.buffers()[2] is not None else b""
    return tuple(pa.array(v.astype(np.int32), mask=v == NONE).take(found.indices) for v in tag_values(raw, offs[:-1], offs[1:]))


Regions = dict[str, list[tuple[int, int]] | None]  # by chromosome, half-open; None is all of it


def merged(regions: list[tuple[str, int, int]]) -> Regions:
    """Regions that lie apart, in order."""
    out: dict[str, list[tuple[int, int]]] = {}
    for chrom, lo, hi in sorted(regions):
        own = out.setdefault(chrom, [])
        if own and lo <= own[-1][1]:
            own[-1] = own[-1][0], max(hi, own[-1][1])
        else:
            own.append((lo, hi))
    return out


def within(data: bytes, rec: Fields, names: list[str], wanted: Regions) -> Fields:
    """The records that overlap a region; one without aligned bases takes the base of its place."""
    rec = rec.of(np.isin(rec.tid, [k for k, name in enumerate(names) if name in wanted]))
    if not any(wanted.values()):
        return rec
    row, op, size = cigar_words(data, rec.cigar, rec.n_cigar)
    last = rec.pos + np.maximum(1, np.bincount(row, np.where(C.MOVE[op], size, 0), len(rec.pos)).astype(np.int64))
    hit = np.zeros(len(rec.tid), bool)
    for k in np.unique(rec.tid).tolist():
        mine, places = rec.tid == k, wanted[names[k]]
        if places is None:
            hit[mine] = True
            continue
        lo, hi = np.array(places).reshape(-1, 2).T
        before = np.searchsorted(lo, last[mine]) - 1
        hit[mine] = (before >= 0) & (hi[np.maximum(before, 0)] > rec.pos[mine])
    return rec.of(hit)


def decoded(data: bytes, rec: Fields, sample: int, names: list[str]) -> pa.RecordBatch:
    """Records as rows of READS."""
    chroms = pa.DictionaryArray.from_arrays(pa.array(rec.tid.astype(np.int32), mask=rec.tid < 0), pa.array(names, pa.string())).cast(pa.string())
    qnames = _pieces(data, rec.name, rec.cigar - 1, pa.string())
    small = lambda x: pa.array(x.astype(np.int32))
    return pa.RecordBatch.from_arrays([small(np.full(len(rec.tid), sample)), qnames, small(rec.flag), chroms, pa.array(rec.pos), small(rec.mapq), _cigars(data, rec), *_tag_columns(data, rec)], schema=_ARROW)


def counted(data: bytes, rec: Fields, sample: int, names: list[str], min_anchor: int, min_mapq: int, n_only: bool) -> pa.RecordBatch | None:
    """Junction counts of these records, as operators.reads.junction_counts() has them."""
    rec = rec.of((rec.flag & EXCLUDED_FLAGS == 0) & (rec.mapq >= min_mapq) & (rec.n_cigar > 1))
    row, start, end, anchor = C.junctions(*C.placed(*cigar_words(data, rec.cigar, rec.n_cigar), len(rec.tid), rec.pos, n_only), min_anchor)
    if not len(row):
        return None
    used, back = np.unique(row, return_inverse=True)
    few = rec.of(used)
    nh = tag_values(data, few.tags, few.end)[0]
    place = few.tid[back] * 2 + (few.flag[back] & REVERSE != 0)
    order = np.lexsort((end, start, place))
    place, start, end, anchor, back = place[order], start[order], end[order], anchor[order], back[order]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])]))
    total = lambda x: np.add.reduceat(x.astype(np.float64), first)
    mapq, n = few.mapq[back], np.diff(np.append(first, len(place)))
    chroms = pa.DictionaryArray.from_arrays(pa.array((place[first] >> 1).astype(np.int32), mask=place[first] < 0), pa.array(names, pa.string())).cast(pa.string())
    strands = pa.DictionaryArray.from_arrays(pa.array((place[first] & 1).astype(np.int32)), pa.array(["+", "-"])).cast(pa.string())
    values = [chroms, start[first], end[first], strands, np.full(len(first), sample, np.int32), n, total(mapq), total(mapq * mapq), total(np.where(nh == NONE, 1, nh)[back]), n, np.maximum.reduceat(anchor, first)]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=_COUNTS)


def _bins_over(lo: int, hi: int) -> list[range]:
    """Bins of the index that can hold records over [lo, hi): six levels, each bin in eight of the next."""
    return [range(((1 << 3 * k) - 1) // 7 + (lo >> 29 - 3 * k), ((1 << 3 * k) - 1) // 7 + (hi - 1 >> 29 - 3 * k) + 1) for k in range(6)]


def index_ranges(raw: bytes, names: list[str], wanted: Regions, split: int = SPLIT_BYTES) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Ranges of places (block, within it) that hold the records of regions, by a BAM index; all begin and end at records.

    A region's bins name the chunks that can hold its records; what ends before the first record
    over the region's first window of 16,384 bases, as the linear index has it, holds none.
    """
    if raw[:4] != b"BAI\1":
        raise ValueError("not a BAM index")
    p, out = 8, []
    for k in range(struct.unpack_from("<i", raw, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        n_bin = struct.unpack_from("<i", raw, p)[0]
        p += 4
        for _ in range(n_bin):
            name, n_chunk = struct.unpack_from("<Ii", raw, p)
            p += 8
            if name != PSEUDO_BIN and n_chunk:
                chunks = struct.unpack_from(f"<{2 * n_chunk}Q", raw, p)
                bins[name] = list(zip(chunks[::2], chunks[1::2]))
            p += 16 * n_chunk
        n_line = struct.unpack_from("<i", raw, p)[0]
        line = struct.unpack_from(f"<{n_line}Q", raw, p + 4)
        p += 4 + 8 * n_line
        if names[k] not in wanted or not bins:
            continue
        places = wanted[names[k]]
        if places is None:
            own = sorted(c for chunks in bins.values() for c in chunks)
            own = [(min(own[0][0], *(v for v in line if v)) if any(line) else own[0][0], max(e for _, e in own))]
        else:
            own = []
            for lo, hi in places:
                lo, hi = max(lo, 0), min(hi, 1 << 29)
                if lo < hi:
                    least = next((v for v in line[lo >> 14 :] if v), None) if n_line > lo >> 14 else None
                    if least is not None:
                        own += [(max(a, least), b) for level in _bins_over(lo, hi) for name in (level if len(level) < len(bins) else [n for n in bins if n in level]) for a, b in bins.get(name, ()) if b > least]
            own.sort()
        marks = sorted({v for v in line if v} | {a for chunks in bins.values() for a, _ in chunks})
        apart: list[list[int]] = []
        for a, b in own:
            if apart and (a >> 16) - (apart[-1][1] >> 16) <= NEAR_BYTES:
                apart[-1][1] = max(b, apart[-1][1])
            else:
                apart.append([a, b])
        for a, b in apart:
            cuts = [a]
            for v in marks[bisect_right(marks, a) : bisect_left(marks, b)]:
                if (v >> 16) - (cuts[-1] >> 16) >= split:
                    cuts.append(v)
            place = [(v >> 16, v & 0xFFFF) for v in [*cuts, b]]
            out += zip(place, place[1:])
    return out


def _opened(path: str):
    """A file, to be read from any place, in any store pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return open(re.sub(r"^file:/*", "/", path), "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _size(stream) -> int:
    size = stream.seek(0, 2)
    return stream.tell() if size is None else size


def _index(path: str) -> bytes | None:
    for name in (f"{path}.bai", re.sub(r"\.bam$", ".bai", path)):
        try:
            with _opened(name) as stream:
                return stream.read()
        except FileNotFoundError:
            continue
    return None


class _Split(InputPartition):
    """Records from `start` (a place of a block and within it, None where that is to be found) to `end`; without either, all of a file that has no blocks."""

    def __init__(self, path: str, sample: int, start: tuple[int, int | None] | None, end: tuple[int, int] | None):
        self.path, self.sample, self.start, self.end = path, sample, start, end


class _BamReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int, regions: Regions | None = None, counts: tuple[int, int, bool] | None = None):
        self.paths, self.split, self.regions, self.counts = paths, split, regions, counts
        self.chroms: frozenset[str] | None = None
        self.lo, self.hi = 0, 1 << 40

    def pushFilters(self, filters: list[Filter]):
        """Chromosomes and bounds of `pos` tell what to read; Spark filters the rows all the same."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and f.value is not None:
                self.chroms = frozenset([f.value]) & (self.chroms if self.chroms is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("chrom",):
                self.chroms = frozenset(f.value) & (self.chroms if self.chroms is not None else frozenset(f.value))
            elif f.attribute == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and f.value is not None:
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            if f.attribute == ("pos",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and f.value is not None:
                self.hi = min(self.hi, f.value + (not isinstance(f, LessThan)))
            yield f

    def wanted(self) -> Regions | None:
        """What is to be read, None for all."""
        if self.regions is not None:
            return self.regions if self.chroms is None else {c: r for c, r in self.regions.items() if c in self.chroms}
        if self.chroms is None:
            return None
        bounded = self.lo > 0 or self.hi < 1 << 40
        return dict.fromkeys(self.chroms, [(self.lo, max(self.lo, self.hi))] if bounded else None)

    def partitions(self):
        return [split for i, path in enumerate(self.paths) for split in self._splits(path, i)] or [_Split("", 0, None, None)]

    def _splits(self, path: str, sample: int) -> Iterator[_Split]:
        wanted = self.wanted()
        with _opened(path) as stream:
            if not is_blocked(stream):
                yield _Split(path, sample, None, None)
                return
            raw = _index(path) if wanted is not None else None
            if raw is not None:
                names = header(_Bytes(content for _, content in blocks(stream, 0)))
                for start, end in index_ranges(raw, names, wanted, self.split):
                    yield _Split(path, sample, start, end)
                return
            size = _size(stream)
            for at in range(0, size, self.split):
                yield _Split(path, sample, (at, None), (min(at + self.split, size), 0))

    def read(self, partition: _Split):
        if not partition.path:
            return
        wanted = self.wanted()
        with _opened(partition.path) as stream:
            blocked = partition.start is not None
            head = _Bytes((content for _, content in blocks(stream, 0)) if blocked else _inflate(stream))
            known = references(head)
            names, lengths = [n for n, _ in known], [n for _, n in known]
            if not blocked:
                rest = iter([(0, head.buffer[head.at :])])
                found = split_records(chain(rest, enumerate(head.parts, 1)), 0, (1 << 62, 0), lengths)
            elif partition.start[0] == 0:
                found = split_records(blocks(stream, 0), head.taken if partition.start[1] is None else partition.start[1], partition.end, lengths)
            else:
                at = partition.start[0] if partition.start[1] is not None else first_block(stream, partition.start[0])
                if at is None or at >= partition.end[0] and partition.start[1] is None:
                    return
                found = split_records(blocks(stream, at), partition.start[1], partition.end, lengths)
            for data, begins in found:
                rec = fields(data, begins)
                if wanted is not None:
                    rec = within(data, rec, names, wanted)
                if self.counts is None:
                    yield decoded(data, rec, partition.sample, names)
                elif (batch := counted(data, rec, partition.sample, names, *self.counts)) is not None:
                    yield batch


class BamSource(DataSource):
    """Options: path, or paths joined by newlines; sample_idx is the place in the list.

    splitBytes is the compressed size of a task.  regions, JSON of [chrom, start, end], keeps the
    reads that overlap any of them.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return READS

    def _reader(self, counts: tuple[int, int, bool] | None = None) -> _BamReader:
        paths = [p for p in (self.options.get("paths") or self.options["path"]).split("\n") if p]
        told = self.options.get("regions")
        return _BamReader(paths, int(self.options.get("splitBytes") or SPLIT_BYTES), merged([(c, int(a), int(b)) for c, a, b in json.loads(told)]) if told else None, counts)

    def reader(self, schema):
        return self._reader()


class BamCounts(BamSource):
    """Junction counts of each stretch of a BAM file, to be summed; options minAnchor, minMapq and nOnly."""

    @classmethod
    def name(cls) -> str:
        return "bam_junctions"

    def schema(self) -> str:
        return COUNTS

    def reader(self, schema):
        return self._reader((int(self.options["minAnchor"]), int(self.options["minMapq"]), self.options["nOnly"] == "true"))


Places = list[tuple[str, int, int]]


def _bam(spark: SparkSession, source: type[BamSource], paths: list[str], split_bytes: int, regions: Places | None):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("paths", "\n".join(paths)).option("splitBytes", split_bytes)
    return reader if regions is None else reader.option("regions", json.dumps(regions))


def read_bam(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES, regions: Places | None = None) -> DataFrame:
    """BAM files as reads; with regions (chrom, start, end; half-open), the reads that overlap one."""
    return _bam(spark, BamSource, paths, split_bytes, regions).load()


def bam_junction_counts(spark: SparkSession, paths: list[str], min_anchor: int = 6, min_mapq: int = 0, n_only: bool = False, split_bytes: int = SPLIT_BYTES, regions: Places | None = None) -> DataFrame:
    """The same as junction_counts(read_bam(...)), counted where the records are decoded: no read becomes a row."""
    parts = _bam(spark, BamCounts, paths, split_bytes, regions).option("minAnchor", min_anchor).option("minMapq", min_mapq).option("nOnly", str(n_only).lower()).load()
    return parts.groupBy(*JUNCTION, "sample_idx").agg(*(F.sum(c).alias(c) for c in _COUNTS[5:10]), F.max("max_anchor").alias("max_anchor"))


def bam_chromosomes(path: str) -> list[str]:
    with open(path, "rb") as stream:
        return header(_Bytes(_inflate(stream)))


def default_chromosomes(names: list[str], annotated: set[str] | None = None) -> list[str]:
    """chr names of at most five characters, those with genes if a set is given."""
    return [c for c in names if c.startswith("chr") and len(c) <= 5 and (annotated is None or c in annotated)]


def standard_chromosomes(sex: bool = True) -> list[str]:
    return [f"chr{k}" for k in range(1, 23)] + (["chrX", "chrY"] if sex else [])


def discover(folder: str) -> dict[str, object]:
    """Inputs in a benchmark folder: BAM files in order, the first four against the next four, annotation and genome.

    Groups are empty where there are fewer than eight files, paths empty where nothing is found.
    """
    import os

    first = lambda *names: next((p for n in names if os.path.exists(p := os.path.join(folder, n))), "")
    inside = next((d for d in (os.path.join(folder, "bam"), os.path.join(folder, "data"), folder) if os.path.isdir(d) and any(f.endswith(".bam") for f in os.listdir(d))), None)
    bams = sorted(os.path.join(inside, f) for f in os.listdir(inside) if f.endswith(".bam")) if inside else []
    enough = len(bams) >= 8
    return {"group1": bams[:4] if enough else [], "group2": bams[4:8] if enough else [], "gtf": first("data/annotation.gtf", "annotation.gtf"), "genome": first("data/genome.fa", "genome.fa")}
