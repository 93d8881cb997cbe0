"""Every operator on nulls, empty, white and very long texts, ties, repeated rows, clashing columns and empty tables."""

import pytest

from junctura.llm import classlm, decontam, exact, licenses, mixing, neardup, pages, tokencount, toxicity, urls


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "a benchmark item of ten words that nobody else has"), (2, None), (None, "no id"), (3, "")], "item_id bigint, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 0, 1), (6, 1, 0), (None, 1, 1), (9, 1, None), (6, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_exact(odd, none):
    rows = exact.exact_groups(odd).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].keep_id == by[2].keep_id == by[3].keep_id == 3 and by[1].group_size == 4  # most code points first
    assert by[4].kept and not by[5].kept and by[5].keep_id == 4
    assert by[6].kept and by[6].group_size == 2 and by[7].kept and by[8].kept
    kept = exact.drop_exact(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [3, 4, 6, 7, 8, 9]
    assert exact.drop_exact(odd).columns == odd.columns and exact.drop_exact(none).count() == 0 and exact.exact_groups(none).count() == 0


def test_exact_with_equal_digests(spark, odd):
    from pyspark.sql import functions as F

    want = sorted(map(str, exact.exact_groups(odd).collect()))
    assert sorted(map(str, exact.exact_groups(odd, digest=lambda t: F.lit("same")).collect())) == want


def test_neardup(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert by[5].component_id == 4 and not by[5].kept and by[8].component_id == 7 and by[7].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(none).count() == 0
    out = neardup.drop_near(odd)
    assert out.columns == odd.columns and out.count() == 10 and neardup.drop_near(none).count() == 0


def test_mixing(odd, none):
    rows = mixing.plan_mix(odd).collect()
    assert len(rows) == 12 and all(0 <= r["__jx_mix"].copies <= 2 for r in rows)
    assert {r.doc_id: r["__jx_mix"].size for r in rows}[1] == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0


def test_licenses_tokens_pages_urls(spark, odd, none):
    rows = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert rows[1].n_words == 0 and rows[1].first_word is None and rows[4].n_words == 120_000
    assert licenses.scan_licenses(none).count() == 0
    vocabulary = [("▁", -1.0), ("word", -2.0), ("s", -3.0), ("▁thing", -2.5), ("1", -4.0)]
    counted = {r.doc_id: r for r in tokencount.count_tokens(odd, vocabulary).collect()}
    assert counted[1].n_tokens == counted[2].n_tokens == 0 and counted[4].n_tokens > 100_000
    assert tokencount.count_tokens(none, vocabulary).count() == 0
    web = spark.createDataFrame([(1, None, None), (None, "http://x.org/fr/a", ""), (3, "no scheme", "<p>"), (3, "no scheme", "<p>"), (4, "http://", "<article><p>Only a text that has no end")], "page_id bigint, url string, html string")
    texts = [(r.page_id, r.text, r.n_chars) for r in pages.extract_text(web).collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [(1, "", 0), (None, "", 0), (3, "", 0), (3, "", 0), (4, "Only a text that has no end", 27)]))
    judged = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in urls.judge_urls(web).collect())
    assert judged == sorted([("1", "", "", "None", "allow"), ("None", "x.org", "/fr/a", "org/fr/", "allow"), ("3", "", "", "None", "allow"), ("3", "", "", "None", "allow"), ("4", "", "", "None", "allow")])
    assert urls.judge_urls(web, rules=[]).count() == 5 and urls.judge_urls(web.limit(0)).count() == 0 and pages.extract_text(web.limit(0)).count() == 0


def test_decontamination(odd, none, benchmark):
    assert decontam.find_leaks(odd, benchmark).count() == 0 and decontam.find_leaks(none, benchmark).count() == 0
    assert decontam.find_leaks(odd, benchmark.limit(0)).count() == 0
    assert decontam.drop_leaks(odd, benchmark).count() == 12 and decontam.drop_leaks(none, benchmark).count() == 0


def test_language_model(odd, none):
    rows = classlm.score_texts(odd, classlm.fold("doc_id", 10) == 0).collect()
    assert len(rows) == 12 and all(r.score <= 0 or r.train_tokens == 0 for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 1 and sum(r.doc_id == 6 for r in rows) == 2
    assert classlm.score_texts(none, classlm.fold("doc_id", 10) == 0).count() == 0


def test_toxicity(odd, none, labels):
    rows = toxicity.score_toxicity(odd, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns and toxicity.drop_toxic(none, labels).count() == 0


def test_mixing_rows_without_or_with_repeated_ids(spark):
    """2,000 equal rows a source, all without an id or with one id, come near their targets, and reruns agree."""
    from pyspark.sql import functions as F

    rows = [(None if s == "a" else 7 if s == "b" else k, "ten words " * 5, s) for s in "abc" for k in range(2000)] + [(9, "x y", None), (9, "x y", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    taken = lambda: {r.source: r for r in mixing.plan_mix(docs).groupBy("source").agg(F.sum(F.col("__jx_mix.size") * F.col("__jx_mix.copies")).alias("taken"), F.first("__jx_mix.target").alias("target"), F.count("*").alias("n"), F.max("__jx_mix.copies").alias("most")).collect()}
    first = taken()
    assert {s: r.n for s, r in first.items()} == {"a": 2000, "b": 2000, "c": 2000, None: 3}
    for s in "abc":
        assert abs(first[s].taken - first[s].target) < 0.05 * first[s].target and first[s].most <= 2, first[s]
    assert {s: r.taken for s, r in taken().items()} == {s: r.taken for s, r in first.items()}


def test_mixing_sql_agrees_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = [(None, "one two three", "a")] * 7 + [(5, "one two", "a"), (5, "other words here", "b"), (6, "x", None), (6, "x", None), (8, None, "b"), (None, None, None), (9, "z z z z", "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(mixing.SQL["op6_mix"]).fetchall()
    got = [tuple(r) for r in mixing.op6_mix(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_neardup_of_ids_with_two_texts(spark):
    """200 ids with two texts each, and a near copy of each text under an id of its own: no link is lost."""
    words = lambda tag, n=40: [f"{tag}w{i}" for i in range(n)]
    rows = []
    for k in range(200):
        for side in "ab":
            own = words(f"{side}{k}")
            rows += [(k, " ".join(own)), (1000 + 2 * k + (side == "b"), " ".join([*own, "more"]))]
    rows += [(5000, "alone " + " ".join(words("z"))), (5000, "alone " + " ".join(words("z"))), (None, " ".join(words("a0"))), (5001, None), (5001, " ".join(words("a1")))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    for k in range(200):
        assert by[k] == {(k, True)} and by[1000 + 2 * k] == by[1001 + 2 * k] == {(k, False)}, k
    assert by[5000] == {(5000, True)} and by[None] == {(None, True)}
    assert {c for c, _ in by[5001]} <= {1, 5001} and (1, False) in by[5001]
