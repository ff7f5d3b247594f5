"""Check-in rules as a stream and as a batch, upserts, alerts and daily counts."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from panelwright.streaming import checkins as C, live as L, records as U


def row(request, entity, month, taken=10, missed=0, at=None, p=0.5):
    return (request, entity, month, None, None, None, None, taken, missed, p, at if at is not None else request)


def batches_to_stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run_memory(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def sequential(rows):
    last, doses, out = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[1], -1 if r[2] is None else r[2], r[10], r[0])):
        request, e, m, taken, missed = r[0], r[1], r[2], r[7], r[8]
        ok = m is not None and 0 <= m <= 12 and (m == 0 or (taken is not None and missed is not None))
        ok = ok and (m == last[e] + 1 if e in last else m in (0, 1))
        out[request] = (ok, doses.get(e, 0) if ok else None)
        if ok:
            last[e] = m
            doses[e] = doses.get(e, 0) + (taken or 0)
    return out


@pytest.fixture(scope="module")
def mess():
    rng = random.Random(6)
    ids = itertools.count(1)
    rows = []
    for e in range(30):
        for m in range(rng.choice([0, 1, 2]), rng.randint(3, 14)):
            if rng.random() < 0.9:
                for _ in range(rng.choice([1, 1, 1, 2])):
                    taken = None if rng.random() < 0.05 else rng.randint(0, 31)
                    rows.append(row(next(ids), e, m, taken, 2))
    rows += [row(next(ids), 5, 13), row(next(ids), 5, -1), row(next(ids), 6, None)]
    rng.shuffle(rows)
    return rows


def test_batch_follows_the_sequential_rules(spark, mess):
    got = C.validated_batch(spark.createDataFrame(mess, C.INPUT)).collect()
    assert {r["request_id"]: (r["accepted"], r["prior_doses"]) for r in got} == sequential(mess)
    assert all((r["reason"] is None) == r["accepted"] for r in got)


def test_stream_in_one_batch_equals_batch(spark, mess, tmp_path):
    stream = batches_to_stream(spark, tmp_path, [mess], C.INPUT)
    got = run_memory(C.validated_stream(stream), "verdicts_one", "append").collect()
    assert {r["request_id"]: (r["accepted"], r["prior_doses"] if r["accepted"] else None) for r in got} == sequential(mess)


def test_stream_over_batches_keeps_state(spark, tmp_path):
    first = [row(2, 1, 1, 20, 5), row(1, 1, 0, None, None)]
    second = [row(3, 1, 1), row(4, 1, 4), row(5, 1, 2, 9, 1), row(6, 1, 2), row(7, 1, 13), row(8, 1, 5, None)]
    stream = batches_to_stream(spark, tmp_path, [first, second], C.INPUT)
    verdicts = run_memory(C.validated_stream(stream), "verdicts_two", "append")
    got = {r["request_id"]: r for r in verdicts.collect()}
    assert [got[i]["accepted"] for i in range(1, 9)] == [True, True, False, False, True, False, False, False]
    assert {i: got[i]["reason"] for i in (3, 4, 6, 7, 8)} == {
        3: "duplicate_or_past", 4: "unexpected_month", 6: "repeated", 7: "month_out_of_range", 8: "doses_required"}
    assert got[5]["prior_doses"] == 20 and got[4]["expected_month"] == 3
    derived = {r["request_id"]: r for r in C.derived_fields(verdicts).collect()}
    assert derived[2]["pct_adherence"] == 0.8 and derived[2]["adherence"] == "partial"
    assert derived[5]["cumulative_doses_taken"] == 29 and derived[1]["is_missing_monthly_doses_taken"] == 1
    assert derived[1]["adherence"] == "poor" and derived[1]["pct_adherence"] is None


def test_check_ins_against_the_register(spark, tmp_path):
    register = spark.createDataFrame([(1, -1, 0, None), (2, 3, 40, 0.4), (2, 1, 10, 0.3), (None, 1, 1, None)], C.REGISTER)
    first = [row(1, 1, 0, None, None), row(2, 9, 0), row(3, 2, 4, 5, p=0.7), row(4, 2, 3), row(5, 9, 13), row(6, 2, 4), row(7, None, 0)]
    second = [row(8, 1, 1, 7), row(9, 9, 1), row(10, 2, 5, None), row(11, 2, 5, 6, p=0.99), row(12, 2, 9)]
    stream = batches_to_stream(spark, tmp_path, [first, second], C.INPUT)
    verdicts = run_memory(C.registered_stream(stream, register), "registered", "append")
    got = {r["request_id"]: r for r in verdicts.collect()}
    assert {i: r["reason"] for i, r in got.items()} == {
        1: None, 2: "unknown_entity", 3: None, 4: "duplicate_or_past", 5: "unknown_entity", 6: "repeated", 7: "unknown_entity",
        8: None, 9: "unknown_entity", 10: "doses_required", 11: None, 12: "unexpected_month"}
    assert got[3]["prior_doses"] == 40 and got[11]["prior_doses"] == 45 and got[8]["prior_doses"] == 0
    made = {r["request_id"]: r for r in C.prediction_rows(verdicts).collect()}
    assert sorted(made) == [1, 3, 8, 11] and made[3]["previous_probability"] == 0.4 and made[1]["previous_probability"] is None
    assert made[11]["previous_probability"] == 0.7 and made[11]["failure_probability"] == 0.95 and made[11]["label"] == 1
    batch = C.validated_batch(spark.createDataFrame(first, C.INPUT), register).collect()
    want = {r["request_id"]: (got[r["request_id"]]["accepted"], got[r["request_id"]]["reason"]) for r in batch}
    assert {r["request_id"]: (r["accepted"], r["reason"]) for r in batch} == want
    assert {r["request_id"]: r["prior_doses"] for r in batch if r["accepted"]} == {1: 0, 3: 40}


def test_entities_registered_while_the_stream_runs(spark, tmp_path):
    rows = [[row(1, 5, 0), row(2, 6, 0)], [row(3, 5, 1), row(4, 6, 1)]]
    stream = batches_to_stream(spark, tmp_path, rows, C.INPUT)
    for i, batch in enumerate([[(6, 0, 3, None)], [(5, -1, 0, None)]]):
        spark.createDataFrame(batch, C.REGISTER).coalesce(1).write.mode("append").parquet(str(tmp_path / "new"))
    news = spark.readStream.schema(C.REGISTER).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "new"))
    nobody = spark.createDataFrame([], C.REGISTER)
    got = {r["request_id"]: r["reason"] for r in run_memory(C.registered_stream(stream, nobody, news), "growing", "append").collect()}
    assert got == {1: "unknown_entity", 2: "duplicate_or_past", 3: None, 4: None}


def test_zero_doses_and_clamped_risk(spark):
    df = spark.createDataFrame([row(1, 1, 0, 0, 0, p=2.0)], C.INPUT)
    got = C.derived_fields(C.validated_batch(df)).first()
    assert got["pct_adherence"] is None and got["adherence"] == "poor" and got["failure_probability"] == 0.95


def test_risk_alerts(spark, tmp_path):
    schema = "entity_id long, failure_probability double, timestamp long"
    stream = batches_to_stream(spark, tmp_path, [[(1, 0.9, 5), (1, 0.2, 1), (1, 0.1, 0)], [(1, 0.3, 9), (2, 0.5, 1), (1, 0.8, 7)]], schema)
    rows = run_memory(L.risk_alerts(stream), "alerts", "update").collect()
    last = {}
    for r in rows:
        if r["timestamp"] >= last.get(r["entity_id"], (None, -1))[1]:
            last[r["entity_id"]] = (r["trend"], r["timestamp"], r["previous"])
    assert last[1] == ("improving", 9, 0.8) and last[2] == (None, 1, None)


def test_equal_timestamps_go_by_the_tie(spark, tmp_path):
    schema = "entity_id long, failure_probability double, timestamp long, no long"
    for name, batches in (("a", [[(1, 0.1, 5, 1)], [(1, 0.9, 5, 3), (1, 0.4, 5, 2)]]), ("b", [[(1, 0.9, 5, 3), (1, 0.1, 5, 1)], [(1, 0.4, 5, 2)]])):
        stream = batches_to_stream(spark, tmp_path / name, batches, schema)
        last = run_memory(L.risk_alerts(stream, "no"), f"ties_{name}", "update").collect()[-1]
        assert (last["latest"], last["previous"]) == (0.9, 0.4)


def test_daily_intake_counts_each_event_once(spark, tmp_path):
    schema = "event_id long, event_type string, ts timestamp_ntz"
    import datetime as dt

    day = dt.datetime(2024, 1, 1, 10)
    stream = batches_to_stream(spark, tmp_path, [[(1, "a", day), (1, "a", day), (2, "a", day)], [(2, "a", day), (3, "b", day)]], schema)
    got = run_memory(L.daily_intake(stream, "ts", "event_id"), "daily", "complete").collect()
    assert {(r["event_type"], r["events"]) for r in got} == {("a", 2), ("b", 1)}


RECORD = "id long, name string, created_at long, updated_at long"


def records(spark, path, **how):
    return {r["id"]: (r["name"], r["created_at"], r["updated_at"]) for r in U.RecordTable(spark, str(path), "id", **how).read().collect()}


def test_upsert_keeps_creation_and_survives_replay(spark, tmp_path):
    path = str(tmp_path / "people")
    sink, table = U.upsert_sink(spark, path, "id"), U.RecordTable(spark, path, "id")
    one = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 11, 11)], RECORD)
    two = spark.createDataFrame([(1, "a2", 50, 50), (1, "a1", 40, 40), (3, "c", 51, 51)], RECORD)
    assert table.read() is None and not table.fold()
    want = {1: ("a2", 10, 50), 2: ("b", 11, 11), 3: ("c", 51, 51)}
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    assert records(spark, path) == want
    assert table.fold() and not table.fold() and records(spark, path) == want
    sink(two, 1)  # a replay of what is folded in already
    table.clean()
    assert records(spark, path) == want and sorted(n.split("-")[0] for n in os.listdir(path) if not n.startswith(".")) == ["bits", "folded"]
    assert U.merge_records(None, two, "id").filter("id = 1").first()["name"] == "a2"


def test_upsert_order_of_batches_makes_no_difference(spark, tmp_path):
    frame = lambda *row: spark.createDataFrame([row], RECORD)
    new, old, tie = frame(1, "new", 60, 60), frame(1, "old", 30, 30), frame(1, "tie", 20, 60)
    results = []
    for name, batches, every in (("a", (new, old, tie), None), ("b", (tie, old, new), None), ("c", (old, tie, new), 1), ("d", (tie, new, old), 2)):
        sink = U.upsert_sink(spark, str(tmp_path / name), "id", fold_every=every)
        for i, batch in enumerate(batches):
            sink(batch, i)
        results.append(records(spark, tmp_path / name))
    assert all(r == results[0] for r in results) and results[0][1][1:] == (20, 60)


def test_a_batch_writes_its_own_rows_whatever_the_table_holds(spark, tmp_path):
    def size(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)

    added = []
    for n in (200, 20_000):
        path = str(tmp_path / str(n))
        table = U.RecordTable(spark, path, "id", bucket_rows=500)
        rows = spark.range(n).selectExpr("id", "concat('name ', id) as name", "id as created_at", "id as updated_at")
        table.write(rows, 0)
        table.fold()
        before = size(path)
        table.write(rows.filter("id < 100").withColumn("updated_at", F.lit(10**9)).coalesce(1), 1)
        added.append(size(path) - before)
        assert table.read().filter(f"updated_at = {10**9}").count() == 100 and table.read().count() == n
    assert abs(added[1] - added[0]) < 200


def test_buckets_double_and_only_those_with_news_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "grown")
    table = U.RecordTable(spark, path, "id", bucket_rows=50)
    rows = spark.range(3000).selectExpr("id", "cast(id as string) as name", "id as created_at", "id as updated_at")
    table.write(rows.filter("id < 300"), 0)
    table.fold()
    assert os.path.exists(f"{path}/folded-0-3")
    table.write(rows.filter("id >= 300"), 1)
    table.fold()
    assert os.path.exists(f"{path}/folded-1-6")  # 64 buckets of about 50
    table.write(rows.filter("id = 7").withColumn("updated_at", F.lit(9999)), 2)
    table.fold()
    assert sum(n.startswith("bucket=") for n in os.listdir(f"{path}/bits-6/upto=2")) == 1
    assert table.read().count() == 3000 and records(spark, path)[7] == ("7", 7, 9999)
    os.remove(f"{path}/folded-2-6")  # as if the job had ended before its marker
    assert records(spark, path)[7] == ("7", 7, 9999) and table.fold()
    table.clean()
    assert table.read().count() == 3000 and records(spark, path)[7] == ("7", 7, 9999)


def test_upsert_refuses_a_folder_with_files_of_its_own(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 11, 11)], RECORD)
    rows.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        U.upsert_sink(spark, str(tmp_path / "plain"), "id")(rows, 0)
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 1


def test_register_state_is_judged_without_a_frame_per_entity(spark):
    """An entity's rows pass as they are; state that does not change is not written."""
    import pandas as pd

    class State:
        def __init__(self, value):
            self.value, self.writes = value, 0

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

        put = update

    def judged(rows):
        judge = C.RegisteredCheckins()
        judge.progress, judge.recent = State((3, 40)), State([(3, 0.4)])
        names = [c.split()[0] for c in C.INPUT.split(", ")]
        full = [C.Row(**dict(zip(names, r)), early=None, registers=False) for r in rows]
        out = list(judge.handleInputRows((2,), iter(full), None))
        assert not any(isinstance(r, pd.DataFrame) for r in out)
        return {r["request_id"]: r["reason"] for r in out}, judge

    got, judge = judged([row(1, 2, 3), row(2, 2, 9), row(3, 2, 3)])
    assert got == {1: "duplicate_or_past", 2: "unexpected_month", 3: "repeated"}
    assert judge.progress.writes == judge.recent.writes == 0
    got, judge = judged([row(2, 2, 5, 1, p=None), row(1, 2, 4, 2, p=0.7)])
    assert got == {1: None, 2: None} and judge.progress.value == (5, 43) and judge.recent.value == [(3, 0.4), (4, 0.7)]


def test_a_judged_row_carries_its_check_in_as_one_column(spark, tmp_path):
    """few columns cross over to the judge, and all of a check-in come back as they were."""
    sent = [(i, i % 3, m, w, None, 1, None, 5, None if m > 1 else 2, p, (1 << 53) + i)
            for i, (m, w, p) in enumerate([(0, 70.1, 0.1 + 0.2), (1, 2.5, 1e-300), (0, -0.0, None), (2, 1 / 3, float("inf"))])]
    spark.createDataFrame(sent, C.INPUT).coalesce(1).write.parquet(str(tmp_path / "in"))
    register = spark.createDataFrame([(0, None, None, None), (1, None, None, None)], C.REGISTER)
    stream = spark.readStream.schema(C.INPUT).parquet(str(tmp_path / "in"))
    judged = C.registered_stream(stream, register)
    assert judged.columns == [c.split()[0] for c in C.JUDGED.split(", ")]
    crossing = judged._jdf.queryExecution().analyzed().toString().split("TransformWithState")[1].split("\n")[0]
    assert "weight" not in crossing and "whole" in crossing
    got = {r["request_id"]: r for r in run_memory(judged, "carried", "append").collect()}
    assert [repr(tuple(got[r[0]])[:11]) for r in sent] == [repr(r) for r in sent]
    assert [got[i]["reason"] for i in range(4)] == [None, None, "unknown_entity", "doses_required"]
