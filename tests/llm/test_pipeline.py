"""The stages one by one, and together."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from terrascout.llm import sp_dropout


def test_stages_take_effect(spark, sf_dir, docs, rows):
    names = docs.columns
    texts = dict(rows)
    odd = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    once = pipeline.drop_near_copies(spark, odd, sf_dir)
    assert once.columns == names
    kept = [r.doc_id for r in once.collect()]
    assert len(kept) == len(set(kept)) < len(rows) and None in kept
    clean = pipeline.drop_repeats(spark, once, sf_dir)
    assert clean.columns == names
    left = {r.doc_id: r for r in clean.collect()}
    assert set(left) <= set(kept) and any((r.text or "") != (texts.get(i) or "") for i, r in left.items() if i is not None)
    assert all(r.text is None or r.n_chars == len(r.text) for i, r in left.items() if i is not None)
    assert any(r.text is None for r in left.values())
    mixed = pipeline.mix_sources(spark, clean, sf_dir)
    assert mixed.columns == names
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) <= set(left) and max(times.values()) == 2 and times[None] == 1
    ids = pipeline.encode(spark, mixed, sf_dir)
    assert ids.count() == mixed.count()
    back = {r.doc_id: r.text for r in sp_dropout.decode(ids).collect()}
    assert all((left[i].text or "") == t for i, t in back.items())


def test_empty(spark, sf_dir, no_docs):
    out = no_docs
    for _, stage in pipeline.STAGES:
        out = stage(spark, out, sf_dir)
    assert out.count() == 0


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = out.select("doc_id").distinct()
    assert 0 < kept.count() < before.count() and kept.join(before, "doc_id", "left_anti").count() == 0


def test_repeats_are_joined_without_the_texts_before(spark, sf_dir, docs):
    few = docs.limit(6)
    plan = pipeline.drop_repeats.__wrapped__(spark, few, sf_dir)._jdf.queryExecution().optimizedPlan()
    joined, todo = [], [plan]
    while todo:
        node = todo.pop()
        inside = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joined += [child.output().mkString(" ") for child in inside]
        todo += inside
    assert len(joined) == 2 and "text#" not in joined[0].replace("_text#", "") and "_text#" in joined[1]
