import corpus_pipeline
from pyspark.sql import functions as F

from tallyforge.llm import packing
from tallyforge.llm._session import staged


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        after = docs.collect()
        assert {r.doc_id for r in after} <= set(before)
        if name in ("quality_classifier", "simhash_near_dedup", "source_mixing"):
            assert all(r.text == before[r.doc_id] for r in after)
        else:
            assert all(r.n_chars == len(r.text) for r in after if r.text != before[r.doc_id])
        if name != "source_mixing":
            assert len({r.doc_id for r in after}) == len(after)
        before = {r.doc_id: r.text for r in after}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert sum(r.piece == 0 for r in packed) == docs.count()
    assert len({r.sequence_id for r in packed}) <= sum(r.length for r in packed) / packing.CAPACITY + 2


def test_exact_copies_leave_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.unionByName(docs.limit(20).withColumn("doc_id", F.col("doc_id") + 100_000))
    kept = corpus_pipeline.near_dedup(spark, more, sf_dir).collect()
    assert max(r.doc_id for r in kept) < 100_000
    assert len({r.text for r in kept}) == len(kept)


def test_stages_take_columns_of_any_name(spark, sf_dir):
    names = ["__score", "score", "text_score", "__at", "__id", "__text", "__kept", "row", "whole", "rest", "key", "own", "component"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    plain, odd = docs, docs.withColumns({n: F.lit(f"its {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, odd = staged(stage(spark, plain, sf_dir), name), staged(stage(spark, odd, sf_dir), name)
        assert odd.columns == [*plain.columns, *names]
        assert sorted(map(str, odd.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(r[n] == f"its {n}" for r in odd.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() == corpus_pipeline.STAGES[-1][1](spark, plain, sf_dir).count()


def test_stages_take_nulls_and_repeats(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (2, "x y z q r", "en", None, 9), (2, "other text of its own here", "en", "s", 26), (3, long, "de", "s", len(long))]
    docs = spark.createDataFrame(rows, schema)
    assert corpus_pipeline.quality_filter(spark, docs, sf_dir).columns == docs.columns
    near = sorted((str(r.doc_id), (r.text or "")[:9]) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect())
    assert near == sorted([("1", ""), ("None", "a b c"), ("2", "x y z q r"), ("2", "other tex"), ("3", long[:9])])
    assert corpus_pipeline.substring_dedup(spark, docs, sf_dir).count() == len(rows)
    assert {r.text for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()} >= {"x y z q r"}
    assert sum(r.length for r in corpus_pipeline.pack_sequences(spark, docs, sf_dir).collect()) > 30_000


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "empty")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
