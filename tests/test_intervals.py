"""Interval joins against all pairs: wildcard strands, long and empty intervals, repeated rows, nulls."""

import random

import pytest

from junctura.operators import intervals as I

ROWS = "chrom string, start bigint, end bigint, strand string, id int"


def some(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = rng.choice([rng.randrange(5_000_000), 16384 * rng.randrange(300), (1 << 20) * rng.randrange(5)])
        length = rng.choice([0, 1, 100, 16384, 1 << 20, (1 << 20) + 1, 3_000_000, 200_000_000])
        out.append((rng.choice(["c1", "c1", "c2"]), start, start + length, rng.choice(["+", "-", ".", "*"]), k))
    return out


@pytest.mark.parametrize("any_strand", [False, True])
def test_overlap_join_is_all_pairs_that_overlap(spark, any_strand):
    left, right = some(150, 1), some(200, 2)
    left += left[:3]
    meets = lambda a, b: a == b or (any_strand and "." in (a, b))
    want = sorted((a[4], b[4]) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and a[2] > b[1] and meets(a[3], b[3]))
    odd = [(None, 1, 2, "+", -1), ("c1", None, 5, "+", -2), ("c1", 1, None, ".", -3), ("c1", 1, 9, None, -4)]
    got = I.overlap_join(spark.createDataFrame(left + odd, ROWS), spark.createDataFrame(right + odd, ROWS), any_strand=any_strand)
    assert sorted((r.id, r.r_id) for r in got.collect()) == want and len(want) > 1000
    assert I.overlap_join(spark.createDataFrame(left, ROWS), spark.createDataFrame([], ROWS), any_strand=any_strand).count() == 0


def test_long_intervals_are_in_few_bins(spark):
    rows = spark.createDataFrame([("c1", 0, 1 << 30, ".", 1), ("c1", 5, 10, "+", 2)], ROWS)
    counts = {r.id: r.n for r in I._binned(rows, rows, "", False).groupBy("id").count().withColumnRenamed("count", "n").collect()}
    assert counts[1] <= 65 and counts[2] == 2


def test_a_dense_place_and_long_intervals_merge(spark):
    """Many intervals in one bin, one over all bins, islands that just touch a bin's end."""
    rows = [("c1", 100 + k % 50, 200 + k % 60, "+", k) for k in range(5000)] + [("c1", 5, 64_000, "-", 1)] + [("c1", 1000 * k, 1000 * k + (1000 if k % 3 else 400), "-", k) for k in range(80)]
    for touching in (True, False):
        want = []
        for strand in "+-":
            reach = None
            for _, s, e, _, _ in sorted(r for r in rows if r[3] == strand):
                if reach is None or (s > reach if touching else s >= reach):
                    want.append(["c1", strand, s, e, 0])
                reach = max(e, reach or e)
                want[-1][3:] = reach, want[-1][4] + 1
        for width in (1000, 1 << 20):
            got = I.merge_intervals(spark.createDataFrame(rows, ROWS), touching=touching, bin_width=width)
            assert sorted([r.chrom, r.strand, r.start, r.end, r.n] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("touching", [True, False])
def test_islands_are_swept_in_tasks_of_a_bounded_number_of_rows(spark, monkeypatch, touching):
    rows = [(c, s, e + k % 3, st, k) for c, s, e, st, k in some(3000, 4) if e - s < 200_000] + [("c1", 5, 3_300_000, "+", -1), ("c2", 70, 60, "-", -2), ("c2", 65, 66, "-", -3)]
    want = []
    for key in sorted({(r[0], r[3]) for r in rows}):
        reach = None
        for _, s, e, _, _ in sorted(r for r in rows if (r[0], r[3]) == key):
            if reach is None or (s > reach if touching else s >= reach):
                want.append([*key, s, e, 0])
                reach = e
            reach = max(e, reach)
            want[-1][3:] = max(want[-1][3], e), want[-1][4] + 1
    made, kept = {}, I.written
    monkeypatch.setattr(I, "ROWS", 64, raising=False)
    monkeypatch.setattr(I, "written", lambda df, name: made.setdefault(name, df) and kept(df, name))
    got = I.merge_intervals(spark.createDataFrame(rows, ROWS), touching=touching)
    assert sorted([r.chrom, r.strand, r.start, r.end, r.n] for r in got.collect()) == sorted(want) and len(want) > 100
    # one sort and no table of islands in a task's memory, and as many tasks as the rows need
    assert "Aggregate" not in made["islands"]._jdf.queryExecution().optimizedPlan().toString()
    assert made["islands"].rdd.getNumPartitions() == len(rows) // 64 + 1


def _islands(rows, touching):
    """(chrom, strand, start, end, n) by one sweep of a key's rows."""
    want = []
    for key in {(r[0], r[3]) for r in rows}:
        reach = None
        for _, s, e, _, _ in sorted((r for r in rows if (r[0], r[3]) == key), key=lambda r: r[1:3]):
            if reach is None or (s > reach if touching else s >= reach):
                want.append([*key, s, e, 0])
                reach = e
            reach = max(e, reach)
            want[-1][3:] = max(want[-1][3], e), want[-1][4] + 1
    return sorted(want, key=str)


def _merged(rows):
    return sorted(([r.chrom, r.strand, r.start, r.end, r.n] for r in rows.collect()), key=str)


@pytest.mark.parametrize("touching", [True, False])
def test_tasks_stay_bounded_where_shuffle_partitions_are_many(spark, monkeypatch, touching):
    """Adaptive execution joins small shuffle partitions, so their number bounds nothing."""
    rows = [("c1", 7000 * k, 7000 * k + (7000 if k % 3 else 300), "+-"[k % 2], k) for k in range(3000)]
    made, kept = {}, I.written
    monkeypatch.setattr(I, "ROWS", 64)
    monkeypatch.setattr(I, "written", lambda df, name: made.setdefault(name, df) and kept(df, name))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = I.merge_intervals(spark.createDataFrame(rows, ROWS), touching=touching)
        assert _merged(got) == _islands(rows, touching)
        assert made["islands"].rdd.getNumPartitions() == len(rows) // 64 + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("touching", [True, False])
def test_many_reached_bins_meet_the_islands_in_bounded_partitions(spark, monkeypatch, touching):
    """An interval goes over or up to the end of each bin; keys may be null."""
    rows = [(c, 1000 * k + d, 1000 * k + d + n, "+", k) for c in ("c1", None) for k in range(60) for d, n in ((0, 50), (40, 60), (200, 100), (300, 7), (900, 90 + k % 3 * 10 + k % 7))]
    joined, told = [], I._with_reached
    monkeypatch.setattr(I, "ROWS", 32)
    monkeypatch.setattr(I, "_with_reached", lambda *a: joined.append(told(*a)) or joined[-1])
    got = I.merge_intervals(spark.createDataFrame(rows, ROWS), touching=touching, bin_width=1000)
    assert _merged(got) == _islands(rows, touching) and len(got.collect()) > 200
    plan = joined[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 2
    assert joined[0].rdd.getNumPartitions() >= joined[0].count() // 32


@pytest.mark.parametrize("touching", [True, False])
def test_islands_under_a_long_interval_are_one_row_a_bin(spark, monkeypatch, touching):
    rows = [("c1", 5, 47_500, "+", -1), ("c1", 5, 9, None, -3), (None, 5, 5_000, "+", -4)] + [(c, 20 * k, 20 * k + 8, "+", k) for c in ("c1", None) for k in range(3000)]
    seen, swept = [], I._swept
    monkeypatch.setattr(I, "_swept", lambda df, *a: seen.append(df.count()) or swept(df, *a))
    got = I.merge_intervals(spark.createDataFrame(rows, ROWS), touching=touching, bin_width=1000)
    assert _merged(got) == _islands(rows, touching)
    # of 3,000 islands under long intervals, at most two a bin are swept over bins
    assert seen[0] <= 2 * (48 + 6)


def test_rows_without_a_start_reach_nothing(spark):
    rows = [("c1", 20 * k, 20 * k + 8, "+", k) for k in range(200)]
    got = I.merge_intervals(spark.createDataFrame([*rows, ("c1", None, 3_000, "+", -1)], ROWS), bin_width=1000)
    assert _merged(got.filter("start is not null")) == _islands(rows, True)
