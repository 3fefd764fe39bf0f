"""Queries on made tables whose ids, groups and words go beyond those of the given small ones, against their SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from sparkquire.plans import catalog


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = con.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in df.columns]
    rows = sorted(str(list(r)) for r in df.collect())
    assert rows == sorted(str([r[i] for i in at]) for r in want.fetchall())
    return rows


def test_registry_ids_of_seven_digits(spark, tmp_path):
    keys = [7, 8, 999_997, 999_998, 1_000_000, 1_000_001, 1_200_004, 1_200_005]
    rows = same_as_sql(spark, tmp_path, "q_registry_ids", lineitem={"l_partkey": keys})
    assert "[7, '年龄', 'C-1200006']" in rows


def test_id_registry_of_five_digits(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "q_id_registry", labels={"doc_id": list(range(10_100))})
    assert len(rows) == 10_100


def test_texts_go_to_python_in_small_batches(spark):
    from sparkquire import storage
    from sparkquire.operators import dedup

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.createDataFrame([("1", "abcdefgh")], "id string, text string")
    for made in (dedup.shingles, dedup.shingle_counts, dedup.shared_counts):
        spark.conf.unset(key)
        made(docs)
        assert spark.conf.get(key) == str(storage.BATCH_BYTES)


def test_folds_go_on_over_batches(spark, tmp_path):
    """Sequences of many Arrow batches: none is held whole, and batches and chapters go on where the last stretch ended."""
    from sparkquire.operators import folds

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        n = 200
        events = {"event_type": [("a", "b", None)[i % 3] for i in range(n)], "event_id": list(range(n)), "user_id": [i // 11 for i in range(n)]}
        assert len(same_as_sql(spark, tmp_path, "q_group_batches", events=events | {"event_type": ["ab"[i % 2] for i in range(n)]})) == n
        docs = {"source": ["xy"[i % 2] for i in range(n)], "doc_id": list(range(n)), "n_chars": [i * 37 % 5000 for i in range(n)]}
        for name in ("q_budget_batches", "q_chapter_fallback"):
            same_as_sql(spark, tmp_path, name, documents=docs)
        rows = spark.createDataFrame(list(zip(*events.values())), "event_type string, event_id long, user_id long")
        plan = folds.group_batches(rows, "event_type", "event_id", "user_id", 5)
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().analyzed().toString()
        assert plan.where("event_type is null").agg({"batch": "max"}).first()[0] > 5
    finally:
        spark.conf.set(key, before)


def test_candidates_are_counted_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """A hot subject's scenes are dealt over tasks of bounded rows, no row is multiplied or joined, and facts without a subject form a group."""
    from sparkquire.operators import facts

    n = 600
    lines = {"l_orderkey": [None if i % 50 == 7 else i // 2 for i in range(n)], "l_partkey": [(1, i % 20, None)[min(i % 4, 2)] for i in range(n)], "l_returnflag": ["ANR"[i % 5 % 3] for i in range(n)], "l_quantity": [float(i % 11) for i in range(n)]}
    plans = []

    def ranked(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return numbered(df, *args)

    numbered = facts.numbered
    monkeypatch.setattr(facts, "numbered", ranked)
    monkeypatch.setattr(facts, "SCENE_ROWS", 40, raising=False)
    rows = same_as_sql(spark, tmp_path, "q_fact_candidates", lineitem=lines)
    assert any(r.startswith("[None, ") for r in rows) and any(r.startswith("[1, ") for r in rows)
    assert len(same_as_sql(spark, tmp_path, "q_candidates_cap", lineitem=lines)) == 1
    facts_of = sum(f != "R" for f in lines["l_returnflag"])
    for plan in plans:
        assert "Expand" not in plan and "Join" not in plan
        assert "RepartitionByExpression [subject" in plan and f", {-(-facts_of // 40)}\n" in plan
    merged = facts.merge_values(spark.createDataFrame([(i % 7, "甲", "年龄", f"{i % 3}岁") for i in range(50)] + [(1, "乙", "年龄", "三")], "scene long, subject string, attribute string, value string"))
    assert [tuple(r) for r in facts.candidates(merged).collect()] == [("甲", "年龄", 3, 7, 0, 21, 1)]


def test_sentences_of_a_text_without_dots_are_found_in_one_pass(spark, tmp_path):
    """A text's undotted rest costs its length, not the square of it."""
    import time

    texts = ["a.b", "..a..\nb c.d\n.", ".", "", None, "no dot", "x\r\n\n.y。z.", "four.fives.[S-0001].", "é😀 . .\t.", "wx. " * 1000]
    docs = {"doc_id": list(range(len(texts))), "text": texts}
    assert len(same_as_sql(spark, tmp_path, "q_no_ref_rate", documents=docs)) == 1
    long = {"doc_id": [3, 4, 5], "text": ["abcd. " + "x\n" * 150_000, "ab cd" * 60_000, "abcde." * 10]}
    pq.write_table(pa.table(long), f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    assert [tuple(r) for r in catalog.QUERIES["q_no_ref_rate"](spark, str(tmp_path)).collect()] == [(11, 10, round(10 / 11, 6), 1, 1, 1.0)]
    assert time.monotonic() - start < 20


def test_reference_rates_count_every_reference_and_sentence_once(spark):
    from sparkquire.operators import archive

    rows = [(1, "一", "x[S-0001、S-0002]"), (1, "一", "y[S-0003] and [S-0003]"), (1, "一", "none"), (2, "附", "none"), (2, "附", "z[S-0001]"), (2, None, "none"), (None, "一", "[S-0001]"), (1, "一", None)]
    sentences = spark.createDataFrame(rows, "id long, section string, sentence string")
    allowed = spark.createDataFrame([(1, "S-0001"), (1, "S-0001"), (1, "S-0003"), (2, "S-0002")], "id long, scene string")
    assert [tuple(r) for r in archive.reference_rates(sentences, allowed).collect()] == [(8, 3, 0.375, 6, 3, 0.5)]
    assert [tuple(r) for r in archive.reference_rates(sentences, allowed, ("附",)).collect()] == [(5, 1, 0.2, 6, 3, 0.5)]
    assert [tuple(r) for r in archive.reference_rates(sentences.limit(0), allowed).collect()] == [(0, 0, 0.0, 0, 0, 0.0)]
