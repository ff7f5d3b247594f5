"""Streaming queries: the events folder read as a stream and drained with availableNow."""

from uuid import uuid4

from pyspark.sql import functions as F

from panelwright.catalog.registry import query
from panelwright.session import ensure_checkpoint_dir
from panelwright.sources.tables import read_table
from panelwright.streaming import checkins as C, live as L, records as U


def event_stream(spark, folder):
    """The events file as a stream source; the folder holds other tables, so it is picked by name."""
    schema = read_table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def drain(stream, mode):
    """Runs a stream to its end into Parquet (append) or per-batch Parquet (update)."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        q = writer.outputMode("append").format("parquet").start(f"{base}/out")
    else:
        q = writer.outputMode(mode).foreachBatch(
            lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/b{n}")
        ).start()
    q.awaitTermination()
    path = f"{base}/out" if mode == "append" else f"{base}/out/*"
    return spark.read.parquet(path)


def as_checkins(events):
    """Events of the first thirteen days as check-ins: the day is the month, errors lack doses."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    dosed = F.col("event_type") != "error"
    return events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("entity_id"),
        F.floor(day / 2).cast("int").alias("month"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("weight"),
        F.lit(None).cast("double").alias("height"), F.lit(None).cast("int").alias("smear_tb_lamp"),
        F.when(F.col("event_type") == "signup", 1).alias("xpert_mtb_rif"),
        F.when(dosed, F.floor("value").cast("int") % 31).alias("monthly_doses_taken"),
        F.when(dosed, F.lit(3)).alias("monthly_missed_doses"),
        (F.col("value") / 100).alias("failure_probability"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
    )


_CHECKINS = """
base AS (
  SELECT event_id AS request_id, user_id AS entity_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 2 AS INTEGER) AS month,
         epoch_us(ts) // 1000 AS timestamp, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INTEGER) % 31 END AS taken FROM events),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, month ORDER BY timestamp, request_id) AS rn
  FROM base WHERE month BETWEEN 0 AND 12 AND (month = 0 OR taken IS NOT NULL)),
f AS (SELECT *, month - row_number() OVER (PARTITION BY entity_id ORDER BY month) AS island, min(month) OVER (PARTITION BY entity_id) AS lo
      FROM firsts WHERE rn = 1),
ok AS (SELECT *, sum(coalesce(taken, 0)) OVER (PARTITION BY entity_id ORDER BY month) - coalesce(taken, 0) AS prior
       FROM f WHERE lo <= 1 AND island = lo - 1)"""


@query("T1", "W11", sql=f"""
WITH {_CHECKINS}
SELECT b.request_id, o.request_id IS NOT NULL AS accepted, CAST(o.prior AS BIGINT) AS prior_doses
FROM base b LEFT JOIN ok o USING (request_id)""")
def checkin_verdicts(spark, folder):
    verdicts = C.validated_batch(as_checkins(read_table(spark, folder, "events")))
    return verdicts.select("request_id", "accepted", "prior_doses")


@query("T1", sql=f"""
WITH {_CHECKINS}
SELECT b.request_id, o.request_id IS NOT NULL AS accepted, CAST(o.prior AS BIGINT) AS prior_doses
FROM base b LEFT JOIN ok o USING (request_id)""")
def checkin_stream(spark, folder):
    out = drain(C.validated_stream(as_checkins(event_stream(spark, folder))), "append")
    return out.select(
        "request_id", "accepted", F.when(F.col("accepted"), F.col("prior_doses")).alias("prior_doses")
    )


def entity_register(spark, folder):
    """Customers as the register: a fifth is missing, a third has records of two months."""
    seen = F.col("c_custkey") % 3 == 0
    return read_table(spark, folder, "customer").filter("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("entity_id"), F.when(seen, 1).otherwise(-1).alias("last_month"),
        F.when(seen, F.col("c_nationkey")).otherwise(0).cast("long").alias("doses"),
        F.when(seen, F.abs("c_acctbal") / 10000).alias("probability"),
    )


_REGISTERED = """
base AS (
  SELECT event_id AS request_id, user_id AS entity_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 2 AS INTEGER) AS month,
         epoch_us(ts) // 1000 AS timestamp, value / 100 AS p, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INTEGER) % 31 END AS taken FROM events),
known AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END AS last, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 0 END AS doses,
  CASE WHEN c_custkey % 3 = 0 THEN abs(c_acctbal) / 10000 END AS before FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT b.*, k.last, k.doses, k.before, CASE WHEN k.entity_id IS NULL THEN 'unknown_entity' WHEN month NOT BETWEEN 0 AND 12 THEN 'month_out_of_range'
        WHEN month > 0 AND taken IS NULL THEN 'doses_required' END AS own FROM base b LEFT JOIN known k USING (entity_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY entity_id, month ORDER BY timestamp, request_id) AS rn FROM j WHERE own IS NULL),
f AS (SELECT *, month <= last AS past, month - row_number() OVER (PARTITION BY entity_id, month <= last ORDER BY month) AS island,
        min(month) OVER (PARTITION BY entity_id, month <= last) AS lo FROM c WHERE rn = 1),
ok AS (SELECT *, doses + sum(coalesce(taken, 0)) OVER (PARTITION BY entity_id ORDER BY month) - coalesce(taken, 0) AS prior
       FROM f WHERE NOT past AND island = lo - 1 AND CASE WHEN last >= 0 THEN lo = last + 1 ELSE lo <= 1 END),
verdicts AS (
  SELECT j.request_id, ok.request_id IS NOT NULL AS accepted, CAST(ok.prior AS BIGINT) AS prior_doses,
    CASE WHEN j.own IS NOT NULL THEN j.own WHEN f.request_id IS NULL THEN 'repeated' WHEN f.past THEN 'duplicate_or_past'
         WHEN ok.request_id IS NULL THEN 'unexpected_month' END AS reason
  FROM j LEFT JOIN f ON f.request_id = j.request_id LEFT JOIN ok ON ok.request_id = j.request_id)"""


@query("T1", "W11", sql=f"WITH {_REGISTERED} SELECT * FROM verdicts")
def checkin_register(spark, folder):
    """Check-ins against the register as one batch: verdict and reason."""
    rows = as_checkins(read_table(spark, folder, "events"))
    verdicts = C.validated_batch(rows, entity_register(spark, folder))
    return verdicts.select("request_id", "accepted", "prior_doses", "reason")


@query("T1", "W11", sql=f"WITH {_REGISTERED} SELECT * FROM verdicts")
def checkin_register_stream(spark, folder):
    """The same as a stream whose state starts from the register."""
    out = drain(C.registered_stream(as_checkins(event_stream(spark, folder)), entity_register(spark, folder)), "append")
    return out.select("request_id", "accepted", F.when(F.col("accepted"), F.col("prior_doses")).alias("prior_doses"), "reason")


@query("T1", "W4", sql=f"""
WITH {_REGISTERED}, 
l AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY entity_id ORDER BY month), before) AS q0 FROM ok),
b AS (SELECT request_id, month, least(0.95, greatest(0, p)) AS p, CASE WHEN q0 IS NOT NULL THEN least(0.95, greatest(0, q0)) END AS q FROM l)
SELECT request_id, month, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS label, round(p, 6) AS failure_probability, round(q, 6) AS previous_probability, round(p - q, 6) AS change FROM b""")
def checkin_predictions(spark, folder):
    """Prediction rows of the accepted check-ins of the stream, each with the one before."""
    out = drain(C.registered_stream(as_checkins(event_stream(spark, folder)), entity_register(spark, folder)), "append")
    made = C.prediction_rows(out)
    return made.select("request_id", "month", "label", *[F.round(c, 6).alias(c) for c in ("failure_probability", "previous_probability", "change")])


@query("T2", "W7", "P31", "P32", "P34", sql=f"""
WITH {_CHECKINS}
SELECT request_id, round(CAST(taken AS DOUBLE) / (taken + 3), 6) AS pct_adherence,
       CASE WHEN CAST(taken AS DOUBLE) / (taken + 3) >= 0.9 THEN 'full' WHEN CAST(taken AS DOUBLE) / (taken + 3) >= 0.5 THEN 'partial' ELSE 'poor' END AS adherence,
       CAST(prior + taken AS BIGINT) AS cumulative_doses_taken,
       CASE WHEN taken IS NULL THEN 1 ELSE 0 END AS is_missing_monthly_doses_taken FROM ok""")
def checkin_derivations(spark, folder):
    out = C.derived_fields(C.validated_batch(as_checkins(read_table(spark, folder, "events"))))
    return out.select(
        "request_id", F.round("pct_adherence", 6).alias("pct_adherence"), "adherence",
        "cumulative_doses_taken", "is_missing_monthly_doses_taken",
    )


@query("T4", "W4", sql="""
WITH r AS (SELECT user_id AS entity_id, value / 500 AS p, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS n FROM events)
SELECT entity_id, round(max(CASE WHEN n = 1 THEN p END), 6) AS latest, round(max(CASE WHEN n = 2 THEN p END), 6) AS previous
FROM r WHERE n <= 2 GROUP BY 1""")
def risk_alert_stream(spark, folder):
    rows = event_stream(spark, folder).select(
        F.col("user_id").alias("entity_id"), (F.col("value") / 500).alias("failure_probability"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "event_id",
    )
    out = drain(L.risk_alerts(rows, "event_id"), "update")
    last = U.latest_per_key(out, "entity_id", [F.desc("_batch")])
    return last.select("entity_id", F.round("latest", 6).alias("latest"), F.round("previous", 6).alias("previous"))


@query("T5", sql="""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2""")
def daily_counts_stream(spark, folder):
    out = drain(L.daily_intake(event_stream(spark, folder), "ts", "event_id"), "update")
    last = out.groupBy("day", "event_type").agg(F.max_by("events", "_batch").alias("events"))
    return last.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("T3", sql="""
WITH u AS (SELECT user_id AS id, event_type AS name, epoch_us(ts) // 1000 AS t, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS n FROM events)
SELECT id, max(CASE WHEN n = 1 THEN name END) AS name, max(t) AS updated_at FROM u GROUP BY 1""")
def entity_upsert_stream(spark, folder):
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = event_stream(spark, folder).select(
        F.col("user_id").alias("id"), F.col("event_type").alias("name"), t.alias("created_at"),
        t.alias("updated_at"), "event_id",
    )
    base = f"{ensure_checkpoint_dir(spark)}/upsert-{uuid4().hex}"
    q = (
        rows.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/state")
        .foreachBatch(U.upsert_sink(spark, f"{base}/table", "id", tie="event_id"))
        .start()
    )
    q.awaitTermination()
    return U.RecordTable(spark, f"{base}/table", "id", "event_id").read().select("id", "name", "updated_at")


@query("T3", sql="""
WITH u AS (SELECT user_id AS id, event_type AS name, epoch_us(ts) // 1000 AS t, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS n FROM events)
SELECT id, max(CASE WHEN n = 1 THEN name END) AS name, max(t) AS updated_at, min(t) AS created_at FROM u GROUP BY 1""")
def entity_upsert_any_order(spark, folder):
    """Batches of which later ones hold older updates, two folded in and one not: the newest wins."""
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = read_table(spark, folder, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("name"), t.alias("created_at"),
        t.alias("updated_at"), "event_id",
    )
    middle = rows.agg(F.avg("updated_at")).first()[0]
    table = f"{ensure_checkpoint_dir(spark)}/upsert-{uuid4().hex}/table"
    sink = U.upsert_sink(spark, table, "id", tie="event_id", fold_every=2, bucket_rows=1000)
    sink(rows.filter(F.col("updated_at") >= middle), 0)
    sink(rows.filter((F.col("updated_at") < middle) & (F.col("event_id") % 2 == 0)), 1)
    sink(rows.filter((F.col("updated_at") < middle) & (F.col("event_id") % 2 == 1)), 2)
    return U.RecordTable(spark, table, "id", "event_id").read().select("id", "name", "updated_at", "created_at")
