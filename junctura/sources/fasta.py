"""Genome sequence from FASTA files, read by byte ranges.

`spark.read.format("fasta")` gives tiles (chrom, tile, seq) of upper- or lower-case bases as they
are.  A task holds some SPLIT_BYTES of a contig: the index (`.fai` beside the file, or one that is
derived) tells where the bases of a range are, so no task or record holds a chromosome.  With
a filter on chrom, which is pushed to the reader, other contigs are not read.

An index is derived by a job over byte ranges: each tells, for the lines that begin in it, where
a contig's lines lie and how long they are; the driver joins a row a range and contig.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.sequence import TILE
from .alignments import _opened, _size

SPLIT_BYTES = 16 << 20
SCAN_BYTES = 64 << 20
TILES = "chrom string, tile int, seq string"
STRETCHES = "range int, ord int, name string, start bigint, bases bigint, width bigint, own bigint, least bigint, most bigint, last bigint"


class Contig(NamedTuple):
    """A line of an index: bases, place of the first one, bases of a line and its bytes."""

    name: str
    length: int
    offset: int
    bases: int
    width: int

    def place(self, base: int) -> int:
        return self.offset + base // self.bases * self.width + base % self.bases


def parse_index(text: str) -> list[Contig]:
    rows = [line.split("\t") for line in text.splitlines() if line.strip()]
    return [Contig(r[0], *map(int, r[1:5])) for r in rows]


def _index_beside(path: str) -> list[Contig] | None:
    try:
        with _opened(f"{path}.fai") as stream:
            return parse_index(stream.read().decode())
    except FileNotFoundError:
        return None


class _Range(InputPartition):
    def __init__(self, contig: Contig, first: int, last: int):
        self.contig, self.first, self.last = contig, first, last


class _FastaReader(DataSourceReader):
    def __init__(self, path: str, contigs: list[Contig], tile: int, split: int):
        self.path, self.contigs, self.tile, self.split = path, contigs, tile, split
        self.wanted: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            told = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if told is not None and f.attribute == ("chrom",):
                self.wanted = frozenset(told) & (self.wanted if self.wanted is not None else frozenset(told))
            else:
                yield f

    def partitions(self):
        step = max(1, self.split // self.tile)
        out = []
        for contig in self.contigs:
            if contig.length and (self.wanted is None or contig.name in self.wanted):
                n = -(-contig.length // self.tile)
                out += [_Range(contig, k, min(n, k + step)) for k in range(0, n, step)]
        return out or [_Range(Contig("", 0, 0, 1, 1), 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """Tiles of the range, each with the first base of the next."""
        c, tile = partition.contig, self.tile
        if partition.first == partition.last:
            return
        lo, hi = partition.first * tile, min(c.length, partition.last * tile + 1)
        with _opened(self.path) as stream:
            stream.seek(c.place(lo))
            raw = stream.read(c.place(hi - 1) + 1 - c.place(lo)).translate(None, b"\r\n")
        if len(raw) != hi - lo or b">" in raw:
            raise ValueError(f"the index of {self.path} does not fit {c.name}")
        numbers = range(partition.first, partition.last)
        cuts = [raw[(k * tile) - lo : (k + 1) * tile + 1 - lo] for k in numbers]
        yield pa.RecordBatch.from_arrays([pa.array([c.name] * len(cuts)), pa.array(numbers, pa.int32()), pa.array(cuts, pa.binary()).cast(pa.string())], names=["chrom", "tile", "seq"])


class FastaSource(DataSource):
    """Options: path; tile, bases of a row; index, its text where none lies beside the file."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return TILES

    def reader(self, schema):
        told = self.options.get("index")
        contigs = parse_index(told) if told is not None else _index_beside(self.options["path"])
        if contigs is None:
            raise ValueError(f"{self.options['path']} has no index")
        return _FastaReader(self.options["path"], contigs, int(self.options.get("tile") or TILE), int(self.options.get("splitBytes") or SPLIT_BYTES))


class _Bytes(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


class _ScanReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        with _opened(self.path) as stream:
            size = _size(stream)
        return [_Bytes(k, at, min(at + self.split, size)) for k, at in enumerate(range(0, size, self.split))] or [_Bytes(0, 0, 0)]

    def read(self, partition: _Bytes):
        """A row for each contig, or part of one, whose lines begin in the range."""
        with _opened(self.path) as stream:
            before = max(0, partition.start - 1)
            stream.seek(before)
            data = stream.read(partition.end - before)
            while data and data[-1:] != b"\n" and (more := stream.read(1 << 16)):
                at = more.find(b"\n")
                data += more if at < 0 else more[: at + 1]
        # the first line that begins in the range follows a line's end
        skip = 0 if partition.start == 0 else data.find(b"\n") + 1
        if partition.start and not skip:
            return
        data, at = data[skip:], before + skip
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10)
        begins = np.concatenate([[0], ends + 1])
        ends = np.append(ends, len(raw))
        if begins[-1] == len(raw):
            begins, ends = begins[:-1], ends[:-1]
        begins, ends = begins[begins + at < partition.end], ends[: (begins + at < partition.end).sum()]
        if not len(begins):
            return
        sizes = ends - begins
        bases = sizes - ((sizes > 0) & (raw[np.maximum(ends - 1, 0)] == 13))
        heads = np.flatnonzero((sizes > 0) & (raw[np.minimum(begins, len(raw) - 1)] == ord(">")))
        cuts = np.unique(np.concatenate([[0], heads, [len(begins)]]))
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            named = a in heads
            name = data[begins[a] + 1 : ends[a]].split(None, 1) if named else None
            a += named
            own = bases[a:b]
            full, last = own[:-1], int(own[-1]) if len(own) else -1
            steps = np.diff(begins[a:b])
            width = int(sizes[a]) + 1 if b - a == 1 else 0 if not len(steps) else int(steps[0]) if (steps == steps[0]).all() else -1
            yield (partition.number, k, None if name is None else name[0].decode() if name else "", int(begins[a]) + at if a < len(begins) else int(ends[-1]) + at + 1, int(own.sum()), width, int(own[0]) if len(own) else -1, int(full.min(initial=1 << 60)), int(full.max(initial=-1)), last)


class FastaScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_stretches"

    def schema(self) -> str:
        return STRETCHES

    def reader(self, schema):
        return _ScanReader(self.options["path"], int(self.options.get("scanBytes") or SCAN_BYTES))


def derived_index(spark: SparkSession, path: str, scan_bytes: int = SCAN_BYTES) -> list[Contig] | None:
    """An index of a FASTA file, or None where a contig's lines differ in length, of which no index can tell."""
    spark.dataSource.register(FastaScan)
    rows = spark.read.format("fasta_stretches").option("path", path).option("scanBytes", scan_bytes).load().orderBy("range", "ord").collect()  # a row a range and contig
    out: list[Contig] = []
    short = False  # whether a line that ends the contig, if nothing follows, was shorter
    for r in rows:
        if r.name is not None:
            out.append(Contig(r.name, 0, r.start, 0, 0))
            short = False
        if r.bases == 0 and r.last <= 0 and r.most <= 0:  # nothing but blank lines
            short = short or (r.own == 0 and bool(out))
            continue
        if not out:
            return None
        c = out[-1]
        if not c.bases:
            c = c._replace(offset=r.start, bases=r.own, width=r.width)
        even = r.most in (-1, c.bases) and r.least in (1 << 60, c.bases) and r.last <= c.bases
        follows = r.start == c.offset + c.length // c.bases * c.width  # lines before this stretch took as many bytes as they should
        if short or not even or not follows or r.width < 0 or (r.most >= 0 and r.width != c.width):
            return None
        short = r.last < c.bases
        out[-1] = c._replace(length=c.length + r.bases)
    return out


def fasta_tiles(spark: SparkSession, path: str, tile: int = TILE, split_bytes: int = SPLIT_BYTES, scan_bytes: int = SCAN_BYTES) -> DataFrame | None:
    """The tiles of a FASTA file, by the index beside it or a derived one; None where it can have none."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
    reader = spark.read.format("fasta").option("path", path).option("tile", tile).option("splitBytes", split_bytes)
    if _index_beside(path) is None:
        contigs = derived_index(spark, path, scan_bytes)
        if contigs is None:
            return None
        reader = reader.option("index", "".join("\t".join(map(str, c._replace(bases=c.bases or 1, width=c.width or 1))) + "\n" for c in contigs))
    return reader.load()
