"""Registered ingest, provider, vector and streaming queries with their DuckDB oracles.

Raw inputs the driver tables lack (vendor CSV headers, provider payloads, landed sync files) are
derived from the ledger view by Spark, so their size follows the tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import linear
from ..operators import ledger as L, metrics as MX, vectors as V
from ..session import cut_lineage, shared_path
from ..sources import providers as PV, sinks as SK
from ..sources.tables import MONEY, ledger, line_facts, read_table
from ..streaming import ingest as ST
from . import series as SE
from .sqltext import with_ledger


def squashed(spark: SparkSession, d: str) -> DataFrame:
    return L.squash(ledger(spark, d))


def last_date(df: DataFrame):
    return df.agg(F.max("date")).first()[0]  # one scalar


def resync_batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored ledger up to the day before the last, and a provider resync of the last 3 days
    with revised spend (+10%) and a different bu_code (which must not overwrite stored rows)."""
    sq = squashed(spark, d)
    mx = last_date(sq)
    existing = sq.where(F.col("date") <= F.date_sub(F.lit(mx), 1))
    updates = sq.where(F.col("date") >= F.date_sub(F.lit(mx), 3)).select(
        "date", "service_name", "account_name",
        (F.col("spend") * F.lit(Decimal("1.1"))).cast(MONEY).alias("spend"),
        (F.col("bu_code") + 100).alias("bu_code"), "segment",
    )
    return existing, cut_lineage(updates)  # a resync arrives as data: land it once


def raw_vendor_export(spark: SparkSession, d: str) -> DataFrame:
    """A vendor-style export: alias headers (with blanks), text amounts, two time columns."""
    lg = ledger(spark, d)
    return lg.select(
        F.date_format("date", "yyyy-MM").alias("year_month"),
        F.date_format("date", "MM/dd/yyyy").alias("Date"),
        F.col("spend").cast("string").alias(" cost "),
        F.col("account_name").alias("vendor_name"),
        F.col("service_name").alias("service"),
        F.col("bu_code").cast("string").alias("business_unit"),
        F.col("segment").alias("segment_name"),
        F.col("region"),
    )


def raw_dirty_export(spark: SparkSession, d: str) -> DataFrame:
    """A canonical-header export with the defects ingest must absorb: mixed date layouts, missing
    dates, unparseable amounts and missing services, all placed by rule on the driver tables."""
    lg = ledger(spark, d)
    return lg.select(
        F.when(F.col("bu_code") == 0, F.lit(None).cast("string"))
        .when(F.col("segment") == "BUILDING", F.date_format("date", "MM/dd/yyyy"))
        .otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("usage_family") == "R", F.lit("n/a")).otherwise(F.col("spend").cast("string")).alias("spend"),
        F.when(F.col("service_name") == "PROMO", F.lit(None).cast("string")).otherwise(F.col("service_name")).alias("serviceName"),
        F.col("account_name").alias("accountName"),
        F.col("bu_code").cast("string").alias("buCode"),
        F.col("segment"),
        F.col("spend").cast("string").alias("estimate"),
    )


def q_upsert_ledger(spark: SparkSession, d: str) -> DataFrame:
    existing, updates = resync_batches(spark, d)
    return L.upsert(existing, updates)


def q_ledger_table_merge(spark: SparkSession, d: str) -> DataFrame:
    """S8 + S9 + J2 on the partitioned table: load, merge the resync twice (idempotent), scan."""
    existing, updates = resync_batches(spark, d)
    path = shared_path(spark, "ledger-table")
    SK.write_ledger(existing.withColumn("dataset_id", F.lit("fixture")).select(*SK.LEDGER_TABLE_COLUMNS), path)
    upd = updates.withColumn("dataset_id", F.lit("fixture"))
    SK.merge_into_ledger(spark, path, upd)
    SK.merge_into_ledger(spark, path, upd)
    return SK.scan_ledger(spark, path, "fixture", ("date", "service_name", "account_name", "spend", "bu_code", "segment"))


def q_ledger_reconcile(spark: SparkSession, d: str) -> DataFrame:
    existing, updates = resync_batches(spark, d)
    cols = ["date", "service_name", "account_name", "spend", "bu_code", "segment"]
    return L.reconcile(squashed(spark, d).select(*cols), L.upsert(existing, updates).select(*cols))


def q_alias_mapping(spark: SparkSession, d: str) -> DataFrame:
    raw = L.canonicalise(L.strip_header(raw_vendor_export(spark, d)))
    return L.squash(L.normalise_raw(raw)).select("date", "service_name", "account_name", "spend", "bu_code", "segment")


def q_csv_upload(spark: SparkSession, d: str) -> DataFrame:
    """S1 end to end: the vendor export landed as CSV text in the shared folder, read back with
    the CSV source and ingested."""
    from ..sources.csv_ledger import ingest_csv

    path = shared_path(spark, "upload-csv")
    raw_vendor_export(spark, d).write.option("header", True).csv(path)
    return ingest_csv(spark, path).select("date", "service_name", "account_name", "spend", "bu_code", "segment")


def q_coerce_and_fill(spark: SparkSession, d: str) -> DataFrame:
    raw = L.canonicalise(raw_dirty_export(spark, d))
    return L.squash(L.normalise_raw(raw)).select("date", "service_name", "account_name", "spend", "bu_code", "segment")


def q_quality_report(spark: SparkSession, d: str) -> DataFrame:
    return L.quality_report(raw_dirty_export(spark, d))


def q_synthetic_day(spark: SparkSession, d: str) -> DataFrame:
    monthly = L.squash(ledger(spark, d).withColumn("date", F.trunc("date", "month")))
    raw = monthly.select(F.date_format("date", "yyyy-MM").alias("month"), "service_name", "account_name", "spend")
    return L.add_synthetic_day(raw, key_cols=["service_name", "account_name"])


def q_export_rows(spark: SparkSession, d: str) -> DataFrame:
    f = MX.output_adapter(linear.ols_trend(SE.panel(spark, d), SE.PANEL, SE.H))
    return SK.export_rows(f, filter_cols=SE.PANEL)


def q_records_json(spark: SparkSession, d: str) -> DataFrame:
    return SK.records_json(linear.ols_trend(SE.panel(spark, d), SE.PANEL, SE.H))


def q_aws_flatten(spark: SparkSession, d: str) -> DataFrame:
    flat = PV.flatten_aws(PV.pack_aws(squashed(spark, d)))
    return flat.withColumn("spend", F.col("spend").cast(MONEY))


def q_azure_flatten(spark: SparkSession, d: str) -> DataFrame:
    flat = PV.flatten_azure(PV.pack_azure(squashed(spark, d)))
    return flat.withColumn("spend", F.col("spend").cast(MONEY))


def gcp_export(spark: SparkSession, d: str) -> DataFrame:
    """A GCP-style billing export built from line items: gross price as cost, the discount as a
    credit (no credits when there is no discount; an empty list for a 10% discount)."""
    j = line_facts(spark, d, ("l_extendedprice", "l_discount", "l_shipdate"))
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    credit = (-(price * F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(20,6)")
    credits = (
        F.when(F.col("l_discount") == 0, F.lit(None))
        .when(F.col("l_discount") == 0.1, F.array().cast("array<struct<amount:decimal(20,6)>>"))
        .otherwise(F.array(F.struct(credit.alias("amount"))))
    )
    return j.select(
        F.col("l_shipdate").cast("timestamp").alias("usage_start_time"),
        F.struct(F.col("p_type").alias("description")).alias("service"),
        F.struct(F.col("c_name").alias("name")).alias("project"),
        price.cast("decimal(20,6)").alias("cost"),
        credits.alias("credits"),
    )


def q_gcp_billing(spark: SparkSession, d: str) -> DataFrame:
    return PV.gcp_daily_costs(gcp_export(spark, d), "1996-01-01", "2001-12-31")


def q_vector_match(spark: SparkSession, d: str) -> DataFrame:
    emb = read_table(spark, d, "embeddings")
    anchors = V.centroids(emb, "embedding", "label")
    return V.match_to_anchors(emb, "embedding", anchors, "label", threshold=0.65)


def q_vector_assign(spark: SparkSession, d: str) -> DataFrame:
    """S3 with the assignment rule: each anchor is kept by its first claimant in vec_id order."""
    emb = read_table(spark, d, "embeddings")
    m = V.match_to_anchors(emb, "embedding", V.centroids(emb, "embedding", "label"), "label", threshold=0.65)
    return V.first_claim(m, "vec_id")


def q_stream_daily_spend(spark: SparkSession, d: str) -> DataFrame:
    landing = shared_path(spark, "events-landing")
    ST.land_in_order(read_table(spark, d, "events"), "ts", landing, files=8)
    schema = spark.read.parquet(landing).schema
    return ST.run_daily_spend(spark, landing, schema, shared_path(spark, "daily-spend"), shared_path(spark, "daily-spend-ckpt"), max_files=2)


def q_stream_replay_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """R4 with R2/R3: every event file is delivered twice (a replay); exact repeats are dropped
    within the 3-day watermark, so the daily totals equal a single delivery."""
    landing = shared_path(spark, "events-replay")
    ev = read_table(spark, d, "events")
    ST.land_in_order(ev.unionByName(ev), "ts", landing, files=8)
    schema = spark.read.parquet(landing).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(landing)
    rows = ST.drop_replays(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_id", "ts"])
    agg = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("spend"), F.count(F.lit(1)).alias("events")
    ).select(F.to_date("w.start").alias("day"), "event_type", "spend", "events")
    sink, ckpt = shared_path(spark, "replay-daily"), shared_path(spark, "replay-daily-ckpt")
    q = agg.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(
        ST.keyed_window_sink(sink, ["day", "event_type"], "day")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)


def q_stream_monthly_spend(spark: SparkSession, d: str) -> DataFrame:
    """R3 months: the streaming daily spend rolled up to calendar months inside foreachBatch."""
    landing = shared_path(spark, "events-landing-m")
    ST.land_in_order(read_table(spark, d, "events"), "ts", landing, files=8)
    monthly = shared_path(spark, "monthly-spend")
    ST.run_daily_spend(
        spark, landing, spark.read.parquet(landing).schema, shared_path(spark, "daily-spend-m"),
        shared_path(spark, "daily-spend-m-ckpt"), max_files=2, monthly_sink=monthly,
    )
    return spark.read.parquet(monthly).select("month", "event_type", "spend", "events")


def q_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Syncs of line items with revisions, then for the accounts of one nation two files with equal rows of
    each key's last sync, both of which count, and all first files once more, which do not."""
    landing = shared_path(spark, "billing-landing")
    # line items, so a sync holds several rows of a key; a re-send revises spend and must not touch bu_code
    rows = ledger(spark, d).select("date", "service_name", "account_name", "spend", "bu_code", "segment")
    ST.land_syncs(rows, f"{landing}/first", revise={"spend": F.col("spend") + 1, "bu_code": F.col("bu_code") + 100})
    late = rows.where("bu_code = 3").groupBy("date", "service_name", "account_name").agg(F.lit(0.25).cast(rows.schema["spend"].dataType).alias("spend"), F.max("bu_code").alias("bu_code"), F.max("segment").alias("segment"))
    late = late.withColumn("sync_id", ST.sync_ids()[1])
    for i in range(2):
        late.coalesce(1).write.parquet(f"{landing}/adjustment{i}")
    ST.redeliver(spark, f"{landing}/first", f"{landing}/again")
    schema = spark.read.parquet(f"{landing}/first").schema
    out = ST.ledger_ingest_stream(spark, landing, schema, shared_path(spark, "ledger-stream"), shared_path(spark, "ledger-stream-ckpt"))
    return out.select("date", "service_name", "account_name", "spend", "bu_code", "segment")


def q_run_registry(spark: SparkSession, d: str) -> DataFrame:
    """Datasets are the segments (created at their first spend date); one
    forecast run per panel series with queued / running / done events; latest state + dataset."""
    lg = ledger(spark, d)
    catalog = lg.groupBy(F.col("segment").alias("dataset_id")).agg(F.min("date").alias("created_at"))
    series = lg.select(F.col("segment").alias("dataset_id"), "service_name").distinct()
    status = F.array(F.lit("queued"), F.lit("running"), F.lit("completed"))
    events = series.select(
        F.concat_ws("/", "dataset_id", "service_name").alias("task_id"), "dataset_id",
        F.posexplode(status).alias("seq", "status"),
    )
    runs = SK.run_latest_state(events)
    joined, _orphans = SK.runs_with_dataset(runs, catalog)
    return joined.select("task_id", "dataset_id", "status", "seq", "created_at")


def q_run_state(spark: SparkSession, d: str) -> DataFrame:
    """A run per segment and service with events that each set some fields (queued with the dataset,
    hyperparameters, completed, an insight for runs of over 20 rows); state by field, and whether the run's
    dataset is gone (the catalog has all segments but one)."""
    lg = ledger(spark, d)
    runs = lg.groupBy("segment", "service_name").agg(F.count(F.lit(1)).alias("n"))
    text = lambda c: F.lit(c).cast("string")
    rows = [(0, F.col("segment"), text("queued"), text(None), text(None)), (2, text(None), text("completed"), text(None), text(None)),
            (1, text(None), text("running"), F.col("n").cast("string"), text(None)),
            (3, text(None), text(None), text(None), F.when(F.col("n") > 20, F.concat(F.lit("rows "), F.col("n"))))]
    fields = ["dataset_id", "status", "hyperparameters", "insight"]
    made = F.array(*[F.struct(F.lit(i).alias("seq"), *[v.alias(f) for v, f in zip(r, fields, strict=True)]) for i, *r in rows])
    events = runs.select(F.concat_ws("/", "segment", "service_name").alias("task_id"), F.explode(made).alias("e")).select("task_id", "e.*")
    catalog = lg.where("segment <> 'MACHINERY'").select(F.col("segment").alias("dataset_id")).distinct()
    state = SK.run_state(events, fields)
    kept, orphans = SK.runs_with_dataset(state, catalog)
    return kept.withColumn("orphan", F.lit(False)).unionByName(orphans.withColumn("orphan", F.lit(True)))


def q_newest_dataset(spark: SparkSession, d: str) -> DataFrame:
    lg = ledger(spark, d)
    catalog = lg.groupBy(F.col("region").alias("dataset_id")).agg(F.max("date").alias("created_at"))
    return SK.newest_dataset(catalog)


QUERIES = {k[2:]: v for k, v in dict(globals()).items() if k.startswith("q_") and callable(v)}

# ----------------------------------------------------------------------------- oracles
SQ = """
, sq AS (SELECT date, service_name, account_name, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend, MIN(bu_code) AS bu_code, MIN(segment) AS segment
         FROM ledger GROUP BY 1, 2, 3)"""
UPSERT = SQ + """
, mx AS (SELECT MAX(date) AS d FROM sq)
, ex AS (SELECT sq.* FROM sq, mx WHERE date <= d - INTERVAL 1 DAY)
, up AS (SELECT date, service_name, account_name, CAST(spend * 1.1 AS DECIMAL(18,2)) AS spend, bu_code + 100 AS bu_code, segment
         FROM sq, mx WHERE date >= d - INTERVAL 3 DAY)
, merged AS (
  SELECT COALESCE(e.date, u.date) AS date, COALESCE(e.service_name, u.service_name) AS service_name,
         COALESCE(e.account_name, u.account_name) AS account_name,
         CASE WHEN u.date IS NOT NULL THEN u.spend ELSE e.spend END AS spend,
         CASE WHEN e.date IS NOT NULL THEN e.bu_code ELSE u.bu_code END AS bu_code,
         CASE WHEN e.date IS NOT NULL THEN e.segment ELSE u.segment END AS segment
  FROM ex e FULL OUTER JOIN up u ON e.date = u.date AND e.service_name = u.service_name AND e.account_name = u.account_name)"""

ORACLE = {
    "upsert_ledger": with_ledger(UPSERT + "\nSELECT * FROM merged"),
    "ledger_table_merge": with_ledger(UPSERT + "\nSELECT * FROM merged"),
    "ledger_reconcile": with_ledger(UPSERT + """
SELECT *, 'left_only' AS side FROM (SELECT * FROM sq EXCEPT ALL SELECT * FROM merged)
UNION ALL
SELECT *, 'right_only' AS side FROM (SELECT * FROM merged EXCEPT ALL SELECT * FROM sq)"""),
    "alias_mapping": with_ledger("""
SELECT CAST(date_trunc('month', date) AS DATE) AS date, service_name, account_name, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend,
       MIN(bu_code) AS bu_code, MIN(segment) AS segment FROM ledger GROUP BY 1, 2, 3"""),
    "csv_upload": with_ledger("""
SELECT CAST(date_trunc('month', date) AS DATE) AS date, service_name, account_name, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend,
       MIN(bu_code) AS bu_code, MIN(segment) AS segment FROM ledger GROUP BY 1, 2, 3"""),
    "coerce_and_fill": with_ledger("""
SELECT date, CASE WHEN service_name = 'PROMO' THEN 'Unallocated' ELSE service_name END AS service_name, account_name,
       CAST(SUM(CASE WHEN usage_family = 'R' THEN 0 ELSE spend END) AS DECIMAL(18,2)) AS spend, MIN(bu_code) AS bu_code, MIN(segment) AS segment
FROM ledger WHERE bu_code <> 0 GROUP BY 1, 2, 3"""),
    "synthetic_day": with_ledger("""
, m AS (SELECT strftime(date, '%Y-%m') AS month, CAST(date_trunc('month', date) AS DATE) AS start, service_name, account_name, CAST(SUM(spend) AS DECIMAL(18,2)) AS spend
        FROM ledger GROUP BY ALL)
SELECT month, strftime(start + CAST(CAST('0x' || substr(md5('42|' || month || '|' || service_name || '|' || account_name), 1, 7) AS BIGINT)
         % CAST(day(last_day(start)) AS BIGINT) AS INTEGER), '%m/%d/%Y') AS date, service_name, account_name, spend
FROM m"""),
    "quality_report": with_ledger("""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE bu_code = 0) AS null_date, 0 AS bad_date, 0 AS null_spend,
       COUNT(*) FILTER (WHERE usage_family = 'R') AS bad_spend, COUNT(*) FILTER (WHERE usage_family <> 'R' AND spend < 0) AS negative_spend
FROM ledger"""),
    "export_rows": with_ledger(SE.PANEL_CTE + SE.OLS_CTE + """
SELECT strftime(ds, '%Y-%m-%d') AS "Date",
       CASE WHEN COALESCE(yhat, 0) <> 0 THEN CAST(CAST(CAST(yhat AS DECIMAL(38,6)) AS DECIMAL(18,2)) AS VARCHAR) ELSE '0.00' END AS "Predicted Spend",
       CASE WHEN COALESCE(yhat, 0) <> 0 THEN CAST(CAST(CAST(yhat * 0.9 AS DECIMAL(38,6)) AS DECIMAL(18,2)) AS VARCHAR) ELSE '0.00' END AS "Lower Bound",
       CASE WHEN COALESCE(yhat, 0) <> 0 THEN CAST(CAST(CAST(yhat * 1.1 AS DECIMAL(38,6)) AS DECIMAL(18,2)) AS VARCHAR) ELSE '0.00' END AS "Upper Bound",
       COALESCE(segment, 'All') AS segment, COALESCE(service_name, 'All') AS service_name
FROM ols"""),
    "aws_flatten": with_ledger(SQ + "\nSELECT date, service_name, account_name, spend FROM sq"),
    "azure_flatten": with_ledger(SQ + "\nSELECT date, service_name, account_name, spend FROM sq"),
    "gcp_billing": """
SELECT CAST(l_shipdate AS DATE) AS date, p_type AS service_name, c_name AS account_name,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2))) + SUM(CASE WHEN l_discount = 0 OR l_discount = 0.1 THEN 0
            ELSE -(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2))) END) AS DECIMAL(18,2)) AS spend
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'
GROUP BY 1, 2, 3""",
    "vector_match": """
WITH cells AS (SELECT vec_id, label, UNNEST(embedding) AS v, UNNEST(range(len(embedding))) AS pos FROM embeddings)
, cen AS (SELECT label AS anchor, pos, AVG(CAST(v AS DOUBLE)) AS c FROM cells GROUP BY 1, 2)
, cn AS (SELECT anchor, sqrt(SUM(c * c)) AS nc FROM cen GROUP BY 1)
, vn AS (SELECT vec_id, sqrt(SUM(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS nv FROM cells GROUP BY 1)
, dots AS (SELECT x.vec_id, cen.anchor, SUM(CAST(x.v AS DOUBLE) * cen.c) AS d FROM cells x JOIN cen ON x.pos = cen.pos GROUP BY 1, 2)
, sc AS (SELECT dots.vec_id, dots.anchor, d / NULLIF(nv * nc, 0) AS s FROM dots JOIN vn USING (vec_id) JOIN cn USING (anchor))
, best AS (SELECT vec_id, arg_max(anchor, s) AS a, MAX(s) AS s FROM sc GROUP BY 1)
SELECT e.vec_id, e.label, CASE WHEN s >= 0.65 THEN a END AS mapped_to, ROUND(s, 4) AS confidence,
       CASE WHEN s >= 0.65 THEN 'mapped' ELSE 'unmapped' END AS status
FROM embeddings e JOIN best USING (vec_id)""",
    "vector_assign": """
WITH cells AS (SELECT vec_id, label, UNNEST(embedding) AS v, UNNEST(range(len(embedding))) AS pos FROM embeddings)
, cen AS (SELECT label AS anchor, pos, AVG(CAST(v AS DOUBLE)) AS c FROM cells GROUP BY 1, 2)
, cn AS (SELECT anchor, sqrt(SUM(c * c)) AS nc FROM cen GROUP BY 1)
, vn AS (SELECT vec_id, sqrt(SUM(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS nv FROM cells GROUP BY 1)
, dots AS (SELECT x.vec_id, cen.anchor, SUM(CAST(x.v AS DOUBLE) * cen.c) AS d FROM cells x JOIN cen ON x.pos = cen.pos GROUP BY 1, 2)
, sc AS (SELECT dots.vec_id, dots.anchor, d / NULLIF(nv * nc, 0) AS s FROM dots JOIN vn USING (vec_id) JOIN cn USING (anchor))
, best AS (SELECT vec_id, arg_max(anchor, s) AS a, MAX(s) AS s FROM sc GROUP BY 1)

, m AS (SELECT e.vec_id, e.label, CASE WHEN s >= 0.65 THEN a END AS mapped_to, ROUND(s, 4) AS confidence FROM embeddings e JOIN best USING (vec_id))
, f AS (SELECT mapped_to, MIN(vec_id) AS first_id FROM m WHERE mapped_to IS NOT NULL GROUP BY 1)
SELECT m.vec_id, m.label, m.confidence, CASE WHEN m.vec_id = f.first_id THEN m.mapped_to END AS mapped_to,
       CASE WHEN m.vec_id = f.first_id THEN 'mapped' ELSE 'unmapped' END AS status
FROM m LEFT JOIN f USING (mapped_to)""",
    "stream_daily_spend": """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS spend, COUNT(*) AS events
FROM events GROUP BY 1, 2""",
    "stream_ingest": with_ledger("""
SELECT date, service_name, account_name, CAST(SUM(spend) + CASE WHEN date_diff('day', DATE '1970-01-01', date) % 7 >= 4 THEN COUNT(*) ELSE 0 END
            + CASE WHEN COUNT(*) FILTER (WHERE bu_code = 3) > 0 THEN 0.50 ELSE 0 END AS DECIMAL(18,2)) AS spend,
       MIN(bu_code) AS bu_code, MIN(segment) AS segment
FROM ledger GROUP BY 1, 2, 3"""),
    "stream_monthly_spend": """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS spend, COUNT(*) AS events
FROM events GROUP BY 1, 2""",
    "stream_replay_dedupe": """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS spend, COUNT(*) AS events
FROM events GROUP BY 1, 2""",
    "run_registry": with_ledger("""
, cat AS (SELECT segment AS dataset_id, MIN(date) AS created_at FROM ledger GROUP BY 1)
, s AS (SELECT DISTINCT segment AS dataset_id, service_name FROM ledger)
SELECT s.dataset_id || '/' || s.service_name AS task_id, s.dataset_id, 'completed' AS status, 2 AS seq, cat.created_at
FROM s JOIN cat USING (dataset_id)"""),
    "run_state": with_ledger("""
, r AS (SELECT segment, service_name, COUNT(*) AS n FROM ledger GROUP BY 1, 2)
, c AS (SELECT DISTINCT segment FROM ledger WHERE segment <> 'MACHINERY')
SELECT segment || '/' || service_name AS task_id, segment AS dataset_id, 'completed' AS status, CAST(n AS VARCHAR) AS hyperparameters,
       CASE WHEN n > 20 THEN 'rows ' || n END AS insight, 3 AS last_seq, segment NOT IN (SELECT segment FROM c) AS orphan
FROM r"""),
    "newest_dataset": with_ledger("""
SELECT region AS dataset_id, MAX(date) AS created_at FROM ledger GROUP BY 1 ORDER BY created_at DESC, dataset_id DESC LIMIT 1"""),
}
