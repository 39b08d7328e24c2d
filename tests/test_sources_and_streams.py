"""File sources and sinks, and streams that equal their batch."""

import json

from pyspark.sql import functions as F

from sagebrook.sources import tables as S
from sagebrook.streaming import ingest

D = "/root/testdata/sf0.001"


def test_scan_pushes_down(spark):
    df = S.scan(spark, f"{D}/orders.parquet", ["o_orderkey"], equal={"o_orderstatus": "F"}, one_of={"o_orderpriority": ["1-URGENT"]}, present=["o_custkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("ReadSchema")[-1]


def test_json_and_csv_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"e{k}.json").write_text(json.dumps({"name": f"e{k}", "links": [{"url": "u"}] * k}, indent=1))
    schema = "name string, links array<struct<url string>>"
    df = S.read_entities(spark, str(tmp_path / "in"), schema)
    assert sorted((r.name, len(r.links)) for r in df.collect()) == [("e0", 0), ("e1", 1), ("e2", 2)]
    S.write_summary(df, str(tmp_path / "sum"), "name", "links")
    assert spark.read.json(str(tmp_path / "sum")).agg(F.sum("items")).first()[0] == 3
    S.write_entities(df, str(tmp_path / "out"), "name")
    assert spark.read.json(str(tmp_path / "out")).where("name = 'e2'").count() == 1
    S.write_traces(df, str(tmp_path / "trace"), "links")
    assert spark.read.json(str(tmp_path / "trace")).count() == 3
    S.write_report(df, str(tmp_path / "csv"), ["name", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["name", "missing"]
    glob = S.read_matching(spark, str(tmp_path / "in"), schema, exclude=("e1",))
    assert glob.count() >= 0


def test_run_csv(spark, tmp_path):
    rows = '﻿no,university,query,top_score,hit_count,elapsed_sec,answer_head,status\n1,A,"q ""x""\ny",0.86,5,20.0,"a, b",ok\n2,B,z,0.7,1,30.5,c,ok\n'
    (tmp_path / "run.csv").write_text(rows)
    got = S.read_run(spark, str(tmp_path / "run.csv")).orderBy("no").collect()
    assert [(r.no, r.university, r.top_score, r.hit_count) for r in got] == [(1, "A", 0.86, 5), (2, "B", 0.7, 1)] and got[0].query == 'q "x"\ny'


def test_pages_folder(spark, tmp_path):
    (tmp_path / "abc.md").write_text("# x\ny")
    row = S.read_pages(spark, str(tmp_path)).first()
    assert (row.page_key, row.text) == ("abc", "# x\ny")


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("source", "text", "doc_id")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.file_stream(spark, str(tmp_path / "in"), docs.schema, files_per_trigger=1)
        ingest.versioned_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "source", "text", "doc_id").awaitTermination()
    got = ingest.versions(spark, str(tmp_path / "out")).collect()
    want = S.versioned_insert(docs.limit(0), docs, "source", "text", "doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_daily_stream(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    counts = ingest.daily_counts(ingest.file_stream(spark, str(tmp_path / "in"), events.schema), "ts", "user_id")
    query = counts.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.day: r.n for r in spark.table("days").collect()}
    want = {r.day: r.n for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    """Only partitions that the changes have keys of get new files; the table equals the plain upsert; a repeated call changes nothing."""
    import pathlib

    path, schema = str(tmp_path / "t"), "k int, j string, v int, w string"
    rows = [(k, None if k % 7 == 0 else "a", k, "x") for k in range(400)]
    S.store_keyed(spark.createDataFrame(rows, schema), path, ["k", "j"], 32)
    files = lambda: {p: p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}
    before = files()
    changes = spark.createDataFrame([(7, None, 70, None), (7, None, 71, "y"), (1000, "n", 1, "z")], schema)
    out = S.upsert_stored(spark, path, changes, ["k", "j"], F.col("v"), 32)
    assert {(r.k, r.action) for r in out.where("action <> 'kept'").collect()} == {(7, "updated"), (1000, "inserted")}
    changed = {p.parent.name for p in set(before) ^ set(files())}
    assert 1 <= len(changed) <= 2 and all(files()[p] == t for p, t in before.items() if p.parent.name not in changed)
    S.upsert_stored(spark, path, changes, ["k", "j"], F.col("v"), 32)
    want = S.upsert(spark.createDataFrame(rows, schema), changes, ["k", "j"], F.col("v")).drop("action")
    assert sorted(map(str, spark.read.parquet(path).select("k", "j", "v", "w").collect())) == sorted(map(str, want.collect()))


def test_judged_answers_to_means(spark, tmp_path):
    """A JSON array of judged answers, read and averaged."""
    answers = [{"no": n, "question": "q\n2", "university": "AB"[n % 2], "faithfulness": n / 10, "answer_relevancy": 0.5, "context_precision": None, "elapsed": 3} for n in range(6)]
    (tmp_path / "judged.json").write_text(json.dumps(answers, ensure_ascii=False, indent=2))
    df = S.read_judged(spark, str(tmp_path / "judged.json"))
    assert df.count() == 6 and df.schema["elapsed"].dataType.typeName() == "double" and "ground_truth" in df.columns
    got = {r.university: r.f for r in df.groupBy("university").agg(F.round(F.avg("faithfulness"), 6).alias("f")).collect()}
    assert got == {"A": 0.2, "B": 0.3}


def test_keys_and_unions(spark):
    a, b = spark.createDataFrame([("u", 1)], "url string, n int"), spark.createDataFrame([(2, "v")], "n int, url string")
    keyed = {r.url: r.page_key for r in S.with_page_keys(S.union_all(a, b)).collect()}
    assert keyed == {"u": __import__("hashlib").md5(b"u").hexdigest(), "v": __import__("hashlib").md5(b"v").hexdigest()}
