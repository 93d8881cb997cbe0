"""The jobs: runs over growing input, repeated runs, odd rows, their SQL and their command lines."""

import json
import os
import subprocess
import sys

import pytest
from oracle import check

from jobs import contig_index, junction_ledger, registry
from jobs.common import config, settings
from junctura.operators.reads import READS, junction_counts

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equals_sql(spark, name):
    check(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.SQL[name])


def reads_of(sample, first, n):
    return [(sample, f"r{sample}:{i}", 16 * (i % 2), f"chr{i % 2 + 1}", 100 * (i % 7), 20 + i % 30, f"20M{100 + i % 3}N20M", 1 + i % 2, None) for i in range(first, first + n)]


def put(spark, folder, rows):
    spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(folder)


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def files(folder):
    """Every data file with its time of writing."""
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(folder) for f in names if f.startswith("part-"))


def test_ledger_over_growing_input(spark, tmp_path):
    reads, out, mark = (str(tmp_path / x) for x in ("reads", "out", "mark"))
    put(spark, reads, reads_of(0, 0, 200) + reads_of(1, 0, 150))
    assert junction_ledger.run(spark, reads, out, mark) == 1
    assert rows(junction_ledger.read_counts(spark, out)) == rows(junction_counts(spark.read.parquet(reads)))
    first = files(f"{out}/counts/sample_idx=0")

    put(spark, reads, reads_of(1, 150, 90) + reads_of(2, 0, 60))
    put(spark, reads, reads_of(2, 60, 40))
    assert junction_ledger.run(spark, reads, out, mark, {"files_per_batch": 1}) == 2
    assert rows(junction_ledger.read_counts(spark, out)) == rows(junction_counts(spark.read.parquet(reads)))
    assert files(f"{out}/counts/sample_idx=0") == first  # a sample without new reads is not written again

    before = files(out)
    assert junction_ledger.run(spark, reads, out, mark) == 0
    assert files(out) == before


def test_ledger_batches_can_be_repeated(spark, tmp_path):
    out = str(tmp_path / "out")
    one, two = (spark.createDataFrame(r, READS) for r in (reads_of(0, 0, 100), reads_of(0, 100, 80) + reads_of(3, 0, 10)))
    for batch, rows_of in ((0, one), (1, two), (1, two), (0, one)):
        junction_ledger.take_batch(rows_of, batch, out, junction_ledger.DEFAULTS)
    assert rows(junction_ledger.read_counts(spark, out)) == rows(junction_counts(one.unionByName(two)))


def test_ledger_sets_apart_what_has_no_place(spark, tmp_path):
    out = str(tmp_path / "out")
    odd = [(None, "a", 0, "chr1", 5, 60, "9M9N9M", 1, None), (0, "b", 0, None, 5, 60, "9M9N9M", 1, None), (0, "c", 0, "chr1", None, 60, "9M9N9M", 1, None), (0, "d", 0, "chr1", 5, 60, "9M9Q", 1, None), (0, "e", 0, "chr1", 5, 60, None, 1, None), (0, None, None, "chr1", 5, 60, "9M9N9M", 1, None)]
    fine = [(0, "f", 4, None, None, 0, None, None, None), (0, "g", 0, "chr1", 5, 60, "9M9N9M", None, None)]
    junction_ledger.take_batch(spark.createDataFrame(odd + fine, READS), 0, out, junction_ledger.DEFAULTS)
    assert sorted(str(r.qname) for r in spark.read.parquet(f"{out}/rejected").collect()) == ["None", "a", "b", "c", "d", "e"]
    got = junction_ledger.read_counts(spark, out).collect()
    assert [(r.chrom, r.start, r.end, r.counts, r.nh_sum) for r in got] == [("chr1", 14, 23, 1, 1.0)]


def test_ledger_of_nothing(spark, tmp_path):
    reads, out, mark = (str(tmp_path / x) for x in ("reads", "out", "mark"))
    put(spark, reads, [])
    junction_ledger.run(spark, reads, out, mark)
    assert junction_ledger.read_counts(spark, out).count() == 0
    put(spark, reads, reads_of(0, 0, 5))
    junction_ledger.run(spark, reads, out, mark)
    assert junction_ledger.read_counts(spark, out).count() > 0


CONTIGS = "contig string, assembly string, bases string, extra int"


def index_by_hand(texts, size):
    out = []
    for contig, assembly, text, _ in texts:
        seq = "".join(c if c in "ACGT" else "N" for c in "".join((text or "").split()).replace("a", "A").replace("c", "C").replace("g", "G").replace("t", "T"))
        for k in range((len(seq) + size - 1) // size):
            own = seq[k * size : (k + 1) * size]
            begins = lambda n, words: sum(seq[i : i + n] in words for i in range(k * size, k * size + len(own)))  # noqa: B023, E731
            out.append((contig, k, k * size, k * size + len(own), seq[k * size : (k + 1) * size + 1], len(own) - own.count("N"), own.count("G") + own.count("C"), begins(2, ("GT", "GC", "AT")), begins(2, ("AG", "AC")), begins(3, ("TAA", "TAG", "TGA")), assembly or None))
    return sorted(out, key=str)


TEXTS = [("1", "hg", "acgtTAGNNgcat\nTAA tgaGTAG", 1), ("2", "hg", "ACGTACGT", 1), ("3", None, "gattaca é 日本", 2), ("4", "", "tga", 2), ("5", "t2t", None, 3), ("6", "t2t", " \n", 3), ("7", "t2t", "TAGC" * 5000, 3), ("7", "t2t", "AC", 3), (None, "t2t", "TG", 3)]


def test_contig_index_equals_the_same_by_hand(spark, tmp_path):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    spark.createDataFrame(TEXTS, CONTIGS).repartition(3).write.parquet(texts)
    for size in (4, 8, 1000):
        told = contig_index.run(spark, texts, f"{out}-{size}", {"tile": size})
        want = index_by_hand(TEXTS, size)
        assert sorted((tuple(r) for r in contig_index.read_index(spark, f"{out}-{size}").collect()), key=str) == want
        assert told == {"texts": 9, "tiles": len(want), "bases": sum(r[5] for r in want)}


def test_contig_index_is_overwritten_by_assembly(spark, tmp_path):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    spark.createDataFrame(TEXTS, CONTIGS).write.parquet(texts)
    conf = {"tile": 8}
    contig_index.run(spark, texts, out, conf)
    contig_index.run(spark, texts, out, conf)
    assert sorted((tuple(r) for r in contig_index.read_index(spark, out).collect()), key=str) == index_by_hand(TEXTS, 8)
    kept = files(f"{out}/assembly=t2t")
    changed = [(c, a, "GTGT" if a == "hg" else "TTTT", x) for c, a, _, x in TEXTS]
    spark.createDataFrame(changed, CONTIGS).write.mode("overwrite").parquet(texts)
    contig_index.run(spark, texts, out, conf, ["hg"])
    want = index_by_hand([t if t[1] == "hg" else o for t, o in zip(changed, TEXTS)], 8)
    assert sorted((tuple(r) for r in contig_index.read_index(spark, out).collect()), key=str) == want
    assert files(f"{out}/assembly=t2t") == kept


def test_index_serves_the_library_slices(spark, tmp_path):
    from junctura.functions.sequence import genome_slices

    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    seq = "ACGTTGCATTAGC" * 50
    spark.createDataFrame([("c1", "hg", seq, 0)], CONTIGS).write.parquet(texts)
    contig_index.run(spark, texts, out, {"tile": 16})
    tiles = contig_index.read_index(spark, out).filter("assembly = 'hg'").selectExpr("contig chrom", "tile", "bases seq")
    places = spark.createDataFrame([("c1", a, b) for a, b in ((0, 5), (14, 60), (300, 301))], "chrom string, x_start bigint, x_end bigint")
    assert {r.x for r in genome_slices(places, tiles, "x", 16).collect()} == {seq[0:5], seq[14:60], seq[300:301]}


def test_config_and_settings(spark, tmp_path):
    assert config("lineitem_reads.json", junction_ledger.DEFAULTS)["files_per_batch"] == 4
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"tile": 7}))
    assert config(str(path), contig_index.DEFAULTS, spark) == contig_index.DEFAULTS | {"tile": 7}
    path.write_text(json.dumps({"tiles": 7}))
    with pytest.raises(ValueError, match="tiles"):
        config(str(path), contig_index.DEFAULTS, spark)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), settings(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == was


def test_command_lines(spark, tmp_path):
    reads, texts = str(tmp_path / "reads"), str(tmp_path / "texts")
    put(spark, reads, reads_of(0, 0, 50))
    spark.createDataFrame(TEXTS, CONTIGS).write.parquet(texts)
    for job, args in (("junction_ledger", ["--reads", reads, "--checkpoint", str(tmp_path / "mark")]), ("contig_index", ["--texts", texts])):
        told = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--out", str(tmp_path / job)], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
        assert told.returncode == 0, told.stderr[-2000:]
        assert "junctura.jobs" in told.stderr
    assert junction_ledger.read_counts(spark, str(tmp_path / "junction_ledger")).count() > 0
    assert contig_index.read_index(spark, str(tmp_path / "contig_index")).count() > 0


def test_contig_index_of_nothing(spark, tmp_path):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    spark.createDataFrame([("5", "t2t", None, 3)], CONTIGS).filter("contig = '6'").write.parquet(texts)
    assert contig_index.run(spark, texts, out) == {"texts": 0, "tiles": 0, "bases": 0}
    assert contig_index.read_index(spark, out).count() == 0


def test_patterns_of_bases_meet_no_ascii(spark):
    import re

    from pyspark.sql import functions as F

    from jobs.contig_index import clean

    odd = ["".join(map(chr, range(1, 256))) * 2, "\0acgtnNRY*-\x1f\x7f", "A\u00a0C\u2028G\u3000T\U0001f600a", " \t\n\x0b\x0c\r", "", "acgt" * 50 + "xyz"]
    want = [re.sub("[^ACGT]", "N", re.sub(r"[\x20\x09-\x0D]", "", t).translate(str.maketrans("acgt", "ACGT"))) for t in odd]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)] + [(len(odd), None)], "k int, t string")
    cleaned = rows.select("k", clean(F.col("t")).alias("s"))
    assert [r.s for r in sorted(cleaned.collect())] == [*want, None]
    # a pattern that matches most of a text made the time of the job
    patterns = re.findall(r"(\[\S+?\]), \w?, 1\)", cleaned._jdf.queryExecution().optimizedPlan().toString())
    assert patterns and not [p for p in patterns if re.search(p, "ACGTN")], patterns
