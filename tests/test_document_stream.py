"""Documents that change in a stream leave the tables that batches leave."""

import datetime

import pytest
from pyspark.sql import functions as F

from asofia.operators import chunking, ingest
from asofia.sources.folders import work_folder
from asofia.streaming import jobs

COLUMNS = "source_id string, seq long, title string, issued_date date, effective_from date, updated_on date, withdrawn_on date, version_of date, listed_date date, raw_text string, status string"
DAY = datetime.date(2024, 1, 1)


def row(source, seq, title, text, status="ok", effective=None, issued=DAY):
    return (source, seq, title, issued, effective, None, None, None, None, text, status)


FIRST = [row("a", 1, "A", "one\n\ntwo"), row("b", 2, "B", "three"), row("c", 3, "C", "three"), row("d", 4, "D", ""), row("e", 5, "E", None), row("f", 6, "F", "lost", "missing"), row(None, 7, "N", "none")]
SECOND = [
    row("a", 11, "A", "one\n\nchanged\n\nnow"), row("b", 12, "B2", "three", effective=datetime.date(2025, 1, 1)), row("c", 13, "C", "own text"), row("d", 14, "D", ""),
    row("f", 15, "F", "found"), row("g", 16, "G", "found"), row("h", 17, "H", "undated", issued=None), row("a", 10, "A", "older of this batch"),
]
THIRD = [row("a", 21, "A", "one\n\ntwo"), row("g", 22, "G", "three"), row("f", 23, "F", "found")]


def arrive(spark, rows, folder, files=1):
    spark.createDataFrame(rows, COLUMNS).repartitionByRange(files, "seq").write.mode("append").parquet(folder)


def state(spark, folder):
    rows = spark.read.parquet(f"{folder}/in")
    docs = {r.source_id: (r.title, r.content_hash, r.valid_from) for r in jobs.current_documents(rows, f"{folder}/sink").collect()}
    passages = sorted((r.doc_id, r.ord, r.block) for r in jobs.current_passages(rows, f"{folder}/sink").collect())
    return docs, passages


def test_outcomes_updates_and_retractions(spark):
    folder = work_folder(spark, "changes")
    run = lambda: jobs.document_stream(jobs.arrivals(spark, f"{folder}/in"), f"{folder}/sink", f"{folder}/state", chunking.blocks)
    seen = lambda n: {r.source_id: r.outcome for r in spark.read.parquet(f"{folder}/sink/documents").filter(F.col("batch") == n).collect()}
    arrive(spark, FIRST, f"{folder}/in")
    run()
    assert seen(0) == {"a": "new", "b": "new", "c": "duplicate", "d": "new", "e": "duplicate", "f": "missing"}
    arrive(spark, SECOND, f"{folder}/in")
    run()
    assert seen(1) == {"a": "updated", "b": "updated", "c": "new", "d": "unchanged", "f": "new", "g": "duplicate", "h": "failed"}
    docs, passages = state(spark, folder)
    assert sorted(docs) == ["a", "b", "c", "d", "f"] and docs["b"][0] == "B2" and docs["b"][2] == datetime.date(2025, 1, 1)
    assert passages == [("a", 0, "one"), ("a", 1, "changed"), ("a", 2, "now"), ("b", 0, "three"), ("c", 0, "own text"), ("d", 0, ""), ("f", 0, "found")]
    run()  # nothing has come
    assert state(spark, folder) == (docs, passages)
    arrive(spark, THIRD, f"{folder}/in")
    run()
    assert seen(2) == {"a": "updated", "g": "duplicate", "f": "unchanged"}
    assert [p for p in state(spark, folder)[1] if p[0] == "a"] == [("a", 0, "one"), ("a", 1, "two")]


@pytest.mark.parametrize("files", [1, 3])
def test_same_tables_as_the_batch(spark, files):
    folder = work_folder(spark, "changes")
    frame = lambda rows: ingest.validity(spark.createDataFrame(rows, COLUMNS))
    second = [r for r in SECOND if r[1] != 10]
    none = frame(FIRST).filter("false")
    after = ingest.merged(none, ingest.outcomes(frame([r for r in FIRST if r[0]]), none).select(*none.columns, "outcome"))
    after = ingest.merged(after, ingest.outcomes(frame(second), after).select(*none.columns, "outcome"))
    for rows in (FIRST, second):
        arrive(spark, rows, f"{folder}/in", files)
        jobs.document_stream(jobs.arrivals(spark, f"{folder}/in", 1), f"{folder}/sink", f"{folder}/state", chunking.blocks)
    docs, passages = state(spark, folder)
    if files == 1:
        assert docs == {r.source_id: (r.title, r.content_hash, r.valid_from) for r in after.collect()}
    assert len({h for _, h, _ in docs.values()}) == len(docs)  # no text is there twice
    texts = {r.source_id: r.raw_text for r in spark.createDataFrame([*FIRST, *second], COLUMNS).collect() if r.source_id}
    assert {d for d, _, _ in passages} == set(docs) and all(b in texts[d] for d, _, b in passages)


def test_a_repeated_batch_overwrites_itself(spark):
    folder = work_folder(spark, "changes")
    arrive(spark, FIRST, f"{folder}/in")
    for run in (1, 2):  # a lost checkpoint: batch 0 is made again
        jobs.document_stream(jobs.arrivals(spark, f"{folder}/in"), f"{folder}/sink", f"{folder}/state{run}", chunking.blocks)
        docs, passages = state(spark, folder)
        assert sorted(docs) == ["a", "b", "d"] and len(passages) == 4
