"""Every stage of the pipeline on planted documents."""

import random

import corpus_pipeline
from junctura.llm.common import stash


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("lmnr")
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for k in range(400):
        t = text(120)
        toxic = k % 8 == 0
        if toxic:
            t += " grumblork you snaffwit " + text(5) + " grumblork"
        docs.append((k, t, "en", f"s{k % 3}", len(t)))
        labels.append((k, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 8]
    add = lambda i, t, s="s0": docs.append((i, t, "en", s, len(t)))
    add(1000, clean[0][1].replace(" ", "  "))  # exact copy, longer: it stays and the first goes
    near = clean[1][1].split()
    near[60] = "changed"
    add(1001, " ".join(near))
    item = text(30)
    add(1002, text(40) + " " + item + " " + text(40))
    docs.append(docs[5])
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stash(stage(spark, now, sf), name)
        assert after.columns == now.columns
        gone[name] = sorted({r.doc_id for r in now.collect()} - {r.doc_id for r in after.collect()})
        now = after
    assert gone["toxicity"] == list(range(0, 400, 8))
    assert gone["exact_dedup"] == [clean[0][0]] and now.filter("doc_id = 5").count() == 1
    assert gone["near_dedup"] == [1001] and gone["decontaminate"] == [1002]
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    words = mixed.selectExpr("sum(size(split(text, ' +'))) n").first().n
    assert abs(words / (1.5 * now.selectExpr("sum(size(split(text, ' +'))) n").first().n) - 1) < 0.1
    assert corpus_pipeline.run(spark, sf).count() == mixed.count()
