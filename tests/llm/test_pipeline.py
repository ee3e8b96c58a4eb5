"""The pipeline's stages, each judged on its own input."""

from collections import Counter

import brute
import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_ops import descend, plain_language

from leafweir.llm import langid, mixing, sharding

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = (docs.toPandas(), out.toPandas())
        if name != cp.STAGES[-1][0]:
            assert out.columns == names
        docs = spark.createDataFrame(seen[name][1]) if name != cp.STAGES[-1][0] else out
    before, after = seen["language"]
    assert len(after) >= 0.98 * len(before)
    before, after = seen["near_dedup"]
    assert len(after) == len(set(brute.near_classes(before.text.tolist())))
    before, after = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(after.doc_id) == sorted(r.doc_id for r in before.itertuples() if brute.decontaminated(r.text, items)[1] == 0)
    before, after = seen["language"]
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    far = {i: plain_language(model, t)[2] for i, t in zip(before.doc_id, before.text, strict=True) if t and any(c.isalpha() for c in t)}
    assert {i for i, d in far.items() if d < -1e-4} <= set(after.doc_id) <= {i for i, d in far.items() if d < 1e-4}
    before, after = seen["mix"]
    taken = mixing.mix(spark.createDataFrame(before)).collect()
    times = Counter({r.doc_id: int(r.taken / r["size"] + 0.5) for r in taken if r["size"]})
    assert Counter(after.doc_id) == +times and after.doc_id.value_counts().max() <= 3
    before, after = seen["shard"]
    assert len(before) == len(after) and [*before.columns, *sharding.RESULT] == list(after.columns)
    assert all(r.shard == descend(r.doc_id, sharding.tree(sharding.SHARDS))[1] for r in after.itertuples())
    assert all(sorted(own) == list(range(len(own))) for _, own in after.groupby("shard").slot)


def test_odd_rows_pass_through(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "a", 0), (2, "Just words here to be kept, and some more of them.", "en", "a", 5), (2, "Just words here to be kept, and some more of them.", "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("shard", F.lit("mine"))
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == rows.columns
            docs = docs.cache()
        last = cp.STAGES[-1][1](spark, docs, SF)
        assert last.count() == docs.count() and len(set(last.columns)) == len(last.columns) and dict(last.dtypes)["shard"] == "int"
