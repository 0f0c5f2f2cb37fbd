import random
from datetime import datetime

from pyspark.sql import functions as F

from weftline.streaming import incremental


def test_batches_agree_with_one_run(spark, tmp_path):
    rng = random.Random(3)
    base = [f"w{rng.randrange(80)}" for _ in range(120)]
    texts = []
    for i in range(30):
        w = list(base) if i % 3 else [f"u{i}{k}" for k in range(60)]
        if i % 3 == 2:
            w[5] = f"x{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    path = str(tmp_path / "documents.parquet")
    df.repartition(1).write.parquet(path)
    got = {r.doc_id: r.reason for r in incremental.dedupe_once(spark, path).collect()}
    from weftline.operators import dedupe

    one = dedupe.greedy(df.select(F.lit("all").alias("site"), F.col("doc_id").alias("ord"), "text"))
    assert got == {r.ord: r.reason for r in one.collect()}


def test_registry(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 7 AS user_id", "concat('t', id % 3) AS event_type", "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts")
    path = str(tmp_path / "events.parquet")
    df.repartition(3).write.parquet(path)
    got = {r.user_id: r.event_id for r in incremental.registry_once(spark, path).collect()}
    assert got == {u: max(i for i in range(100) if i % 7 == u) for u in range(7)}


def test_pace(spark):
    got = [r.delay for r in incremental.pace(spark.createDataFrame([("s", i) for i in range(6)], "site string, seq int")).orderBy("seq").collect()]
    assert got == [1.0, 2.0, 4.0, 8.0, 8.0, 8.0]


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    """Started again on its folder, a run reads new files only, against the state of the run before."""
    from weftline.streaming import incremental as I

    text = lambda i: " ".join(f"w{(i % 7) * 50 + k}" for k in range(40))
    docs, folder, state = [(i, text(i)) for i in range(20)], str(tmp_path / "docs"), f"file://{tmp_path}/state"
    put = lambda rows, ddl, where: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(where)
    put(docs[:8], "doc_id bigint, text string", folder)
    first = I.dedupe_files(spark, folder, state).collect()
    assert sorted(r.doc_id for r in first if r.kept) == list(range(7)) and len(first) == 8
    put([*docs[8:], (100, text(100) + " other words that make it new")], "doc_id bigint, text string", folder)
    again = I.dedupe_files(spark, folder, state).collect()
    assert {r.doc_id for r in again if r.kept} == {*range(7), 100} and len(again) == 21
    assert len(I.dedupe_files(spark, folder, state).collect()) == 21

    events = lambda rows: [(u, "t", e, datetime(2024, 1, 1, 0, e)) for u, e in rows]
    ddl, folder = "user_id bigint, event_type string, event_id bigint, ts timestamp", str(tmp_path / "events")
    put(events([(1, 1), (1, 5), (2, 3)]), ddl, folder)
    assert sorted((r.user_id, r.event_id) for r in I.registry(spark, folder, state + "-r").collect()) == [(1, 5), (2, 3)]
    put(events([(1, 4), (2, 9), (3, 2)]), ddl, folder)
    assert sorted((r.user_id, r.event_id) for r in I.registry(spark, folder, state + "-r").collect()) == [(1, 5), (2, 9), (3, 2)]
