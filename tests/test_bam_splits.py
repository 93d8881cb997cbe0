"""BAM files in blocks: splits at any place, records over block ends, reading by index."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.operators.reads import junction_counts
from junctura.sources import alignments as A

NAMES = ["chr1", "chr2", "chr3"]
LENGTH = 5_000_000


def record(name, tid, pos, seq=40, tags=b"NHC\x02ASi" + struct.pack("<i", 77)):
    ops = struct.pack("<3I", 20 << 4, 100 << 4 | 3, (seq - 20) << 4)
    low = name.encode() + b"\0"
    body = struct.pack("<iiIIiiii", tid, pos, len(low) | 60 << 8, 3 | 16 << 16, seq, -1, -1, 0) + low + ops + b"\x12" * ((seq + 1) // 2) + b"\x20" * seq + tags
    return struct.pack("<i", len(body)) + body


def block(content):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = z.compress(content) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(content), len(content))


def smallest_bin(lo, hi):
    """The format's bin of [lo, hi): the deepest of six levels that holds it."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if lo >> shift == hi - 1 >> shift:
            return first + (lo >> shift)
    return 0


def write(path, records, size, index=True):
    """Records (name, tid, pos, bytes) in blocks of `size` bytes, without regard to records, and an index."""
    head = b"BAM\1" + struct.pack("<i", 5) + b"@HD\n\0" + struct.pack("<i", 3) + b"".join(struct.pack("<i", 5) + n.encode() + b"\0" + struct.pack("<i", LENGTH) for n in NAMES)
    data = head + b"".join(r[3] for r in records)
    out, begins = b"", []
    for at in range(0, len(data), size):
        begins.append(len(out))
        out += block(data[at : at + size])
    path.write_bytes(out + block(b""))
    if not index:
        return
    place = lambda at: begins[at // size] << 16 | at % size if at < len(data) else len(out) << 16
    bai, at, refs = b"BAI\1" + struct.pack("<i", 3), len(head), [({}, {}) for _ in NAMES]
    for _, tid, pos, raw in records:
        if tid >= 0:
            end = pos + 120 + struct.unpack_from("<i", raw, 20)[0] - 20
            own = refs[tid][0].setdefault(smallest_bin(pos, end), [])
            if own and own[-1][1] == place(at):
                own[-1] = own[-1][0], place(at + len(raw))
            else:
                own.append((place(at), place(at + len(raw))))
            for w in range(pos >> 14, (end - 1 >> 14) + 1):
                refs[tid][1].setdefault(w, place(at))
        at += len(raw)
    for bins, line in refs:
        bai += struct.pack("<i", len(bins) + 1 if bins else 0)
        for name, chunks in bins.items():
            bai += struct.pack("<Ii", name, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        if bins:
            bai += struct.pack("<Ii4Q", A.PSEUDO_BIN, 2, 0, 1, len(records), 0)
        n = max(line, default=-1) + 1
        bai += struct.pack("<i", n) + struct.pack(f"<{n}Q", *(line.get(k, 0) for k in range(n)))
    path.with_name(path.name + ".bai").write_bytes(bai)


def some(n, long=()):
    rng = random.Random(n)
    places = sorted((rng.randrange(3), rng.randrange(LENGTH)) for _ in range(n))
    rows = [(f"r{k}:{rng.random()}", t, p) for k, (t, p) in enumerate(places)] + [("u1", -1, -1), ("u2", -1, -1)]
    return [(q, t, p, record(q, t, p, 70_000 if k in long else rng.choice([30, 40, 75]))) for k, (q, t, p) in enumerate(rows)]


@pytest.mark.parametrize(("size", "split", "long"), [(700, 1500, ()), (300, 997, ()), (65_000, 20_000, (5, 6, 900)), (65_000, 1 << 26, ())])
def test_splits_hold_every_record_once(spark, tmp_path, size, split, long, monkeypatch):
    rows = some(1500, long)
    write(tmp_path / "a.bam", rows, size)
    monkeypatch.setattr(A, "CHUNK_BYTES", 5000)
    reader = A._BamReader([str(tmp_path / "a.bam")], split)
    parts = reader.partitions()
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want = [(0, q, 16, NAMES[t] if t >= 0 else None, p, 60, f"20M100N{n}M", 2, 77) for q, t, p, n in ((q, t, p, struct.unpack_from("<i", raw, 20)[0] - 20) for q, t, p, raw in rows)]
    assert got == want and (len(parts) > 20 or split > 10_000)
    reader.chroms = frozenset(["chr2"])
    some_parts = reader.partitions()
    got = [r["qname"] for p in some_parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [q for q, t, *_ in rows if t == 1] and (split > 10_000 or 1 < len(some_parts) < len(parts))


def test_index_saves_reading(spark, tmp_path):
    rows = some(3000)
    write(tmp_path / "a.bam", rows, 2000)
    write(tmp_path / "b.bam", rows, 2000, index=False)
    df = A.read_bam(spark, [str(tmp_path / "a.bam"), str(tmp_path / "b.bam")], 20_000)
    assert df.count() == 6004 and df.rdd.getNumPartitions() > 10
    two = df.filter("chrom = 'chr3'")
    assert {(r.sample_idx, r.n) for r in two.groupBy("sample_idx").count().withColumnRenamed("count", "n").collect()} == {(s, sum(t == 2 for _, t, *_ in rows)) for s in (0, 1)}
    assert df.filter("chrom = 'chr9'").count() == 0


REGIONS = [("chr1", 0, 90_000), ("chr1", 1_000_000, 1_000_001), ("chr2", 2_097_100, 2_097_200), ("chr3", 4_990_000, 5_000_000), ("chr3", 4_995_000, 9_000_000), ("chr9", 0, 10)]


def overlapping(rows, regions):
    ends = [(q, NAMES[t], p, p + 100 + struct.unpack_from("<i", raw, 20)[0]) for q, t, p, raw in rows if t >= 0]
    return [q for q, c, p, e in ends if any(c == rc and p < hi and e > lo for rc, lo, hi in regions)]


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("regions", [REGIONS, REGIONS[1:2], [("chr2", 100, 100)], [("chr1", 0, 1 << 40)], []])
def test_regions_hold_what_overlaps_them(tmp_path, index, regions):
    rows = some(4000)
    write(tmp_path / "a.bam", rows, 900, index)
    reader = A._BamReader([str(tmp_path / "a.bam")], 30_000, A.merged(regions))
    got = [r["qname"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == overlapping(rows, regions)


def test_a_region_reads_its_blocks_only(spark, tmp_path, monkeypatch):
    rows = some(100_000)
    write(tmp_path / "a.bam", rows, 4000)
    taken, opened = [], A._opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, *n):
            data = self.f.read(*n)
            taken.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(A, "_opened", lambda path: Counted(opened(path)) if path.endswith(".bam") else opened(path))
    monkeypatch.setattr(A, "READ_BYTES", 1 << 14)
    region = [("chr2", 3_000_000, 3_040_000)]
    reader = A._BamReader([str(tmp_path / "a.bam")], A.SPLIT_BYTES, A.merged(region))
    got = [r["qname"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    size = (tmp_path / "a.bam").stat().st_size
    assert got == overlapping(rows, region) and len(got) > 20
    assert sum(taken) < size / 5, (sum(taken), size)


def test_filters_on_place_reach_the_reader(spark, tmp_path):
    rows = some(3000)
    write(tmp_path / "a.bam", rows, 900)
    df = A.read_bam(spark, [str(tmp_path / "a.bam")], 20_000)
    for text, keep in (("pos >= 1000000 and pos < 1200000", lambda p: 1_000_000 <= p < 1_200_000), ("pos > 4000000", lambda p: p > 4_000_000), ("pos <= 50000", lambda p: p <= 50_000), (f"pos = {rows[1500][2]}", lambda p: p == rows[1500][2])):
        found = df.filter(f"chrom = 'chr2' and {text}")
        assert sorted(r.qname for r in found.collect()) == sorted(q for q, t, p, _ in rows if t == 1 and keep(p))
    assert df.filter("pos < 1000").count() == sum(p < 1000 for _, _, p, _ in rows)


def odd_record(k, rng):
    """Any tags, any operations, none at all."""
    n_ops = rng.choice([0, 1, 2, 3, 5, 12])
    ops = [(rng.randrange(9), rng.choice([1, 5, 9, 50, 1000, 123_456])) for _ in range(n_ops)]
    name = f"q{k}".encode() + b"\0"
    values = {b"A": b"x", b"c": b"\xfb", b"C": b"\xfb", b"s": struct.pack("<h", -300), b"S": struct.pack("<H", 65_000), b"i": struct.pack("<i", -5), b"I": struct.pack("<I", 7), b"f": struct.pack("<f", 1.5), b"Z": b"te:xt\0", b"H": b"1AE3\0", b"B": b"s" + struct.pack("<Ihh", 2, 1, 2)}
    told = {b"c": -5, b"C": 251, b"s": -300, b"S": 65_000, b"i": -5, b"I": 7}
    tags = [(rng.choice([b"NH", b"AS", b"MD", b"XB"]), rng.choice(list(values))) for _ in range(rng.randrange(7))]
    tags = list({n: (n, v) for n, v in tags}.values())
    raw = b"".join(n + v + values[v] for n, v in tags)
    flag = rng.choice([0, 16, 4, 256, 1024, 512, 2048])
    body = struct.pack("<iiIIiiii", rng.randrange(3), 100 * k, len(name) | rng.randrange(61) << 8, n_ops | flag << 16, 7, -1, -1, 0) + name + b"".join(struct.pack("<I", n << 4 | o) for o, n in ops) + bytes(4) + b"\xff" * 7 + raw
    want = (f"q{k}", flag, "".join(f"{n}{'MIDNSHP=X'[o]}" for o, n in ops) or "*", *(next((told.get(v) for n, v in tags if n == t), None) for t in (b"NH", b"AS")))
    return struct.pack("<i", len(body)) + body, want


def test_all_operations_and_tags_are_decoded():
    rng = random.Random(5)
    made = [odd_record(k, rng) for k in range(2000)]
    data, begins = b"", []
    for raw, _ in made:
        begins.append(len(data))
        data += raw
    got = A.decoded(data, A.fields(data, begins), 3, NAMES).to_pylist()
    assert [(r["qname"], r["flag"], r["cigar"], r["nh"], r["as_score"]) for r in got] == [w for _, w in made]
    assert A.decoded(data, A.fields(data, begins).of(np.array([], int)), 3, NAMES).num_rows == 0


@pytest.mark.parametrize(("anchor", "mapq", "n_only"), [(6, 0, False), (1, 30, True)])
def test_counts_made_while_reading_are_those_of_the_reads(spark, tmp_path, anchor, mapq, n_only):
    rng = random.Random(6)
    rows = [(f"q{k}", 0, 100 * k, odd_record(k % 300, rng)[0]) for k in range(3000)]
    write(tmp_path / "a.bam", rows, 800, index=False)
    write(tmp_path / "b.bam", some(2000), 800)
    paths = [str(tmp_path / "a.bam"), str(tmp_path / "b.bam")]
    for regions in (None, [("chr1", 0, 20_000), ("chr2", 1_000_000, 2_000_000)]):
        want = junction_counts(A.read_bam(spark, paths, 10_000, regions), anchor, mapq, n_only)
        got = A.bam_junction_counts(spark, paths, anchor, mapq, n_only, 10_000, regions)
        assert sorted((tuple(r) for r in got.select(want.columns).collect()), key=str) == sorted((tuple(r) for r in want.collect()), key=str)
        assert got.count() > 100


def test_command_line_reads_bam_by_region(spark, tmp_path):
    """A whole run and a drawing on BAM files: counts made while reading, reads of the gene's region."""
    from fixture_set import LABELS, bam, genome, gtf, reads

    from junctura.cli import main

    for s in LABELS:
        (tmp_path / f"{s}.bam").write_bytes(bam([r for r in reads() if r[0] == s]))
    (tmp_path / "g.gtf").write_text(gtf())
    (tmp_path / "g.fa").write_text(">chr1\n" + genome() + "\n")
    files = [x for s in LABELS for x in ("--bam", str(tmp_path / f"{s}.bam"))]
    groups = ["--gtf", str(tmp_path / "g.gtf"), "--group1", "0,1,2", "--group2", "3,4,5"]
    main(["run", *files, *groups, "--genome", str(tmp_path / "g.fa"), "--read-length", "50", "--min-cluster-reads", "10", "-o", str(tmp_path / "out")])
    evidence = {(r.start, r.end): sum(r.sample_counts) for r in spark.read.parquet(str(tmp_path / "out" / "evidence.parquet")).collect()}
    assert evidence == {(r.start, r.end): r.n for r in junction_counts(spark.createDataFrame(reads(), A.READS)).groupBy("start", "end").agg(F.sum("counts").alias("n")).collect()}
    main(["sashimi", "--results", str(tmp_path / "out" / "results.tsv"), *files, *groups, "--n-top", "1", "-o", str(tmp_path / "s")])
    (arcs,) = (tmp_path / "s").glob("*/arcs")
    assert spark.read.parquet(str(arcs)).count() > 0
