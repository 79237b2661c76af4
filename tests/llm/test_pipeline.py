"""Each stage on what its predecessor kept, against the operator's own verdicts."""

import corpus_pipeline as pipeline
from asofia.llm import classifier, decontam, jaccard, queries, rules
from asofia.llm.scratch import Scratch
from helpers import DATA, WORDS, odd_documents


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    verdicts = {
        "quality_classifier": lambda d: ids(classifier.quality_scores(d, classifier.train(d, labels)).filter("predicted = 1")),
        "quality_rules": lambda d: ids(rules.quality_rules(d).filter("kept")),
        "near_duplicates": lambda d: ids(jaccard.jaccard_components(d).filter("doc_id = component_id")),
        "decontamination": lambda d: sorted(set(ids(d)) - set(ids(decontam.contaminated(d, items)))),
    }
    scratch = Scratch(spark, "test")
    for name, stage in pipeline.STAGES[:-1]:
        after = scratch.table(stage(spark, docs, DATA), name)
        assert after.columns == docs.columns and ids(after) == verdicts[name](docs) and 0 < after.count() < docs.count() + (name == "decontamination")
        docs = after
    packed = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(docs)
    assert pipeline.run(spark, DATA).count() == packed.count()


def test_stage_order_and_queries():
    assert [name for name, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "decontamination", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_odd_rows(spark, monkeypatch):
    """Nulls, repeated rows and ids, long texts and columns with the operators' own names pass through the stages."""
    df, rows = odd_documents(spark)
    good = [f"{w}{i * 7919 % 997}" for i, w in enumerate(WORDS * 12)]
    more = [(30, " ".join(good)), (31, " ".join(good)), (31, " ".join(f"x{w}" for w in good)), (32, " ".join(f"y{w}" for w in good)), (32, " ".join(f"y{w}" for w in good)), (None, " ".join(good))]
    df = df.union(spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, "z", 4.0) for i, t in more], df.schema))
    accepted = classifier.keep_accepted(df, classifier.train(df, spark.createDataFrame([], "doc_id long, quality int")), accept=0.5)
    assert accepted.count() == df.count()  # without labels all score 0.5
    docs = df
    for name, stage in pipeline.STAGES[1:-1]:
        docs = Scratch(spark, "odd").table(stage(spark, docs, DATA), name)
        assert docs.columns == df.columns
        found = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.filter("doc_id >= 30 or doc_id is null").select("doc_id").collect())
        assert found == ([-1, -1, 30, 31, 31, 32, 32] if name == "quality_rules" else [-1, -1, 30, 32, 32])
        assert docs.filter("text is null or trim(text) = ''").count() == 0
    packed = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.filter("start = 0").count() == docs.count()


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else docs.limit(0)
