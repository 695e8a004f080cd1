"""Registered queries: file tables, live totals, late rows, sketched history and resumed runs (SNK01, SNK05, SNK07, SNK08, US02, ST11, MO01, PL10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dqflow import shapes as S
from dqflow.catalog.base import query
from dqflow.catalog.feeds import in_deliveries
from dqflow.catalog.storage import finish
from dqflow.operators import history as H
from dqflow.plans import journal as J
from dqflow.plans import medallion as L
from dqflow.session import work_dir
from dqflow.sources import filetable as FT
from dqflow.sources import registry
from dqflow.streaming import ingest, windows

FILES = 128


def at(day: int) -> dt.datetime:
    return dt.datetime(2024, 1, day)


def orders_table(spark, d):
    path = work_dir(spark, "orders-files")
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.lit(0).alias("seq"))
    FT.create(rows, path, "o_orderkey", at(1), FILES)
    return path, rows


def correction(rows, part: int, seq: int):
    """About a hundredth of the orders, next to each other, with their price raised."""
    most = rows.agg(F.max("o_orderkey")).scalar()
    inside = (F.col("o_orderkey") * 100 >= most * part) & (F.col("o_orderkey") * 100 < most * (part + 1))
    return rows.where(inside).withColumns({"o_orderstatus": F.lit("U"), "price": F.col("price") + seq, "seq": F.lit(seq)})


_CORRECTED = """
c AS (SELECT o_orderkey, o_orderstatus, o_totalprice::decimal(18,2) AS price, o_orderkey * 100 // m AS part, o_orderkey * 100 >= m * 40 AND o_orderkey * 100 < m * 41 AS first, o_orderkey * 100 >= m * 70 AND o_orderkey * 100 < m * 71 AS second FROM orders, (SELECT max(o_orderkey) AS m FROM orders))"""


@query("snk01_merge_files", f"WITH {_CORRECTED} SELECT o_orderkey, CASE WHEN first THEN 'U' ELSE o_orderstatus END AS o_orderstatus, (price + first::int)::double AS price FROM c")
def snk01_files(spark, d):
    path, rows = orders_table(spark, d)
    FT.merge(path, correction(rows, 40, 1), "o_orderkey", ["seq"], at(2))
    return FT.read(spark, path).select("o_orderkey", "o_orderstatus", F.col("price").cast("double").alias("price"))


@query("snk01_merge_effort", f"WITH {_CORRECTED} SELECT count(*) FILTER (WHERE first) AS changed, true AS under_five_percent, 0 AS added_by_replay FROM c")
def snk01_effort(spark, d):
    """A merge of a hundredth of the keys rewrites under 5 % of the files; the same merge again writes none."""
    path, rows = orders_table(spark, d)
    change = correction(rows, 40, 1)
    one, two = (FT.merge(path, change, "o_orderkey", ["seq"], at(i)) for i in (2, 3))
    return FT.read(spark, path).agg(
        F.count_if(F.col("seq") > 0).alias("changed"), F.lit(one["rewritten"] * 20 < one["files"]).alias("under_five_percent"), F.lit(two["added"]).alias("added_by_replay"))


def corrected_twice(spark, d):
    path, rows = orders_table(spark, d)
    for i, part in ((1, 40), (2, 70)):
        FT.merge(path, correction(rows, part, i), "o_orderkey", ["seq"], at(1 + i))
    return path


@query("snk05_time_travel", f"""WITH {_CORRECTED}
SELECT v AS version, count(*) AS n, count(*) FILTER (WHERE (first AND v > 1) OR (second AND v > 2)) AS changed, sum(price + CASE WHEN first AND v > 1 THEN 1 WHEN second AND v > 2 THEN 2 ELSE 0 END)::double AS total FROM c, (VALUES (1), (2), (3)) t(v) GROUP BY 1""")
def snk05_versions(spark, d):
    path = corrected_twice(spark, d)
    return registry.union_all([
        FT.read(spark, path, v).agg(F.count("*").alias("n"), F.count_if(F.col("seq") > 0).alias("changed"), F.sum("price").cast("double").alias("total")).select(F.lit(v).alias("version"), "n", "changed", "total")
        for v in (1, 2, 3)])


@query("snk08_vacuum", f"""WITH {_CORRECTED}
SELECT what, version, n FROM (SELECT 'within grace' AS what, unnest([1, 2, 3]) AS version UNION ALL SELECT 'after grace', unnest([2, 3])), (SELECT count(*) AS n FROM c)""")
def snk08_vacuum(spark, d):
    """Two versions are kept: files only the first one needs go once a reader of it has had its time."""
    path = corrected_twice(spark, d)
    out = []
    for what, now in (("within grace", at(4)), ("after grace", at(20))):
        FT.vacuum(spark, path, 2, now, grace_hours=24 * 7)
        out += [(what, v) for v in FT.readable_versions(spark, path)]
    counts = {v: FT.read(spark, path, v).agg(F.count("*").alias("n")) for v in {v for _, v in out if v > 1}}
    counts[1] = S.table(spark, d, "orders").agg(F.count("*").alias("n"))
    return registry.union_all([counts[v].select(F.lit(what).alias("what"), F.lit(v).alias("version"), "n") for what, v in out])


_Z = (("date_of_service", dt.date(1998, 1, 1), dt.date(1998, 1, 7)), ("member_id", "M000000010", "M000000012"), ("provider_npi", "1000000003", "1000000003"))


@query("snk07_z_order", " UNION ALL ".join(
    f"SELECT '{c}' AS filtered, count(*) AS n, sum(claim_amount)::double AS total, true AS under_a_third FROM claims WHERE {c} BETWEEN {'DATE ' if isinstance(lo, dt.date) else ''}'{lo}' AND {'DATE ' if isinstance(hi, dt.date) else ''}'{hi}'" for c, lo, hi in _Z))
def snk07_z(spark, d):
    """Claims along the Z-curve of date, member and provider: a filter on any one of them reads under a third of the files."""
    path = work_dir(spark, "claims-z")
    FT.z_order(S.claims(spark, d).select("claim_id", "claim_amount", *[c for c, _, _ in _Z]), path, [c for c, _, _ in _Z], 64, at(1))
    out = []
    for c, low, high in _Z:
        rows, files, total = FT.read_where(spark, path, c, low, high)
        out.append(rows.agg(F.count("*").alias("n"), F.sum("claim_amount").cast("double").alias("total")).select(
            F.lit(c).alias("filtered"), "n", "total", F.lit(files * 3 < total).alias("under_a_third")))
    return registry.union_all(out)


# -- streams ---------------------------------------------------------------

def live_usage(spark, path, target, cp):
    stream = ingest.file_stream(spark, path, spark.read.parquet(path).schema, "parquet", max_files=1)
    totals = windows.event_time(stream, "timestamp", "2 hours").groupBy(F.window("timestamp", "1 hour"), "tenant_id", "event_type").agg(F.sum("quantity").alias("quantity"))
    return ingest.live_totals(totals.select(F.col("window.start").alias("hour"), "tenant_id", "event_type", "quantity"), target, cp)


@query("us02_live_usage", """
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS hour, tenant_id, event_type, sum(quantity)::double AS quantity FROM usage_events GROUP BY 1, 2, 3""")
def us02_live(spark, d):
    """Hourly usage while it arrives: five deliveries, each changing the hours it touches."""
    path, target = in_deliveries(spark, S.usage_events(spark, d).drop("metadata"), "timestamp", 5, "usage"), work_dir(spark, "live")
    finish(live_usage(spark, path, target, work_dir(spark, "cp")))
    out = ingest.read_live(spark, target, ["hour", "tenant_id", "event_type"])
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "tenant_id", "event_type", F.col("quantity").cast("double").alias("quantity"))


@query("st11_late_rows", """
SELECT count(*) AS delivered, count(*) FILTER (WHERE NOT late) AS kept, count(*) FILTER (WHERE late) AS dropped FROM (
  SELECT event_id % 10 = 0 AND epoch_ms(ts) <= cut AND ts <= make_timestamp(cut * 1000) AS late FROM events, (SELECT max(epoch_ms(ts)) - 864000000 AS cut FROM events WHERE event_id % 10 NOT IN (0, 5)))""")
def st11_rows(spark, d):
    """Every tenth event arrives last: those more than ten days late are dropped, and counted.

    A micro-batch is held against the watermark of the one before it, so the first delivery sets the limit of the third.
    """
    ev, path, target = S.events(spark, d), work_dir(spark, "feed"), work_dir(spark, "kept")
    for due in ("event_id % 10 NOT IN (0, 5)", "event_id % 10 = 5", "event_id % 10 = 0"):
        ev.where(due).coalesce(1).write.mode("append").parquet(path)
    stream = windows.first_seen(ingest.file_stream(spark, path, ev.schema, "parquet", max_files=1), ["event_id"], "ts", "10 days")
    q = ingest.append_to(stream, target, work_dir(spark, "cp"))
    finish(q)
    kept = spark.read.parquet(target).agg(F.count("*").alias("kept"))
    return ev.agg(F.count("*").alias("delivered")).withColumns({"kept": kept.scalar(), "dropped": F.lit(ingest.dropped_rows(q)).cast("bigint")})


# -- history and runs ------------------------------------------------------

@query("mo01_sketch_history", " UNION ALL ".join(f"""
SELECT '{g}' AS granularity, strftime(date_trunc('{g}', ts), '%Y-%m-%d') AS window_start, count(*) AS records, count(*) - count(value) AS null_count, round(avg(value), 1) AS mean, round(stddev_samp(value), 2) AS stddev,
  min(value) AS min_value, max(value) AS max_value, true AS distinct_within, true AS median_within FROM events GROUP BY 2""" for g in ("day", "week", "month")))
def mo01_history(spark, d):
    """Days are stored once; weeks and months merge them. Estimates are held against exact distinct counts and ranks."""
    ev, path = S.events(spark, d), work_dir(spark, "history")
    H.append_days(ev, path, "ts", ["value"])
    stored, out = spark.read.parquet(path), []
    for g in ("day", "week", "month"):
        rolled = H.rolled_up(stored, g).withColumn("median", F.col("quantiles")[1])
        window = F.date_trunc(g, "ts").cast("date").alias("window_start")
        exact = ev.groupBy(window).agg(F.count_distinct("value").alias("exact"))
        share = H.rank_share(ev.select(window, "value").join(rolled.select("window_start", "median"), "window_start"), ["window_start"], "value", "median")
        both = rolled.join(exact, "window_start").join(share, "window_start")
        off = F.greatest(F.col("below") - 0.5, 0.5 - F.col("upto"), F.lit(0.0))
        out.append(both.select(
            "granularity", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "records", "null_count", F.round("mean", 1).alias("mean"), F.round("stddev", 2).alias("stddev"),
            "min_value", "max_value", (F.abs(F.col("distinct_estimate") - F.col("exact")) <= H.DISTINCT_ERROR * F.col("exact") + 1).alias("distinct_within"),
            (off <= H.RANK_ERROR + 1 / F.col("records")).alias("median_within")))
    return registry.union_all(out)


def claim_steps(spark, d, broken: dict):
    """Ingest, bronze, assessment; ``broken`` names steps that fail, and how often they still do."""
    from dqflow.operators import marts as M
    from dqflow.operators import scores as SC

    def guarded(name, work):
        def step(results):
            if broken.get(name, 0):
                broken[name] -= 1
                raise ValueError("source not found")
            return work(results)
        return name, step

    return [
        guarded("ingest", lambda r: S.raw_claims(spark, d)),
        guarded("bronze", lambda r: L.bronze_claims(r["ingest"], S.CLAIMS_AS_OF)),
        guarded("assess", lambda r: M.table_metrics(r["bronze"].withColumns({"_quality_score": SC.quality_score(), "_anomaly_score": SC.anomaly_score()}))),
    ]


@query("pl10_resumed_run", """
SELECT 'SUCCESS' AS status, 3 AS steps_done, 5 AS attempts, 2 AS failures, count(*) AS records, sum(q10) / 10.0::double / count(*) AS quality_score FROM scored WHERE record_id IS NOT NULL""")
def pl10_resumed(spark, d):
    """A run whose second and third step fail once each: resumed twice, every step took effect once."""
    path, broken = work_dir(spark, "run"), {"bronze": 1, "assess": 1}
    for _ in range(3):
        try:
            record = J.run_steps(spark, path, "claims-1", claim_steps(spark, d, broken))
        except ValueError:
            continue
    metrics = J.step_result(spark, path, "claims-1", "assess")
    return record.select("status", F.col("steps_done").cast("int").alias("steps_done"), F.col("attempts").cast("int").alias("attempts"), F.col("failures").cast("int").alias("failures")).withColumns(
        {"records": metrics.select("total_records").scalar(), "quality_score": metrics.select("avg_quality_score").scalar()})
