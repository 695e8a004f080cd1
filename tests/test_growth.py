"""What a task holds or the tasks exchange grows no faster than the table."""

from pyspark.sql import functions as F

from dqflow.sources import merge


def test_compaction_cuts_by_rows_and_spreads_a_frequent_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merge, "RANGE_ROWS", 100, raising=False)
    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("part"), F.lit("one").alias("key"))
    merge.compact(rows, str(tmp_path / "t"), ["key"], 2, ["part"])
    back = spark.read.parquet(str(tmp_path / "t"))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2000 and back.select("id").distinct().count() == 2000
    assert len(sizes) >= 15 and max(sizes) <= 300


def shuffles(df):
    """Exchanges of the plan as Spark would run it, without what AQE changes on the way."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_own_checks_travel_as_outcomes(spark, sf, monkeypatch):
    """the claims are stored as outcomes, no code, amount or status meets the members."""
    from dqflow import shapes as S
    from dqflow.operators import reports as R

    rows = R.claims_with_flags(S.claims(spark, sf), S.eligibility(spark, sf), S.providers(spark, sf))
    assert set(rows.columns) == {"member_id", "date_of_service", *R.claim_checks()}
    assert rows.count() == S.claims(spark, sf).count()
    assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_known_agrees_with_flag_member(spark, monkeypatch):
    """few keys are sent to the tasks, many are shuffled: the same flags."""
    from dqflow.operators import skew

    fact = spark.range(500).select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 50).alias("k"))
    keys = spark.range(20).select((F.col("id") * 3).alias("k"))
    want = sorted(skew.flag_member(fact, keys, "k", "f").collect())
    few = skew.known(fact, keys, "k", "f")
    assert sorted(few.collect()) == want and shuffles(few) == 0
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    assert sorted(skew.known(fact, keys, "k", "f").collect()) == want


def test_recent_duplicates_travel_once(spark):
    """one shuffle of the rows where no key is hot; hot keys, copies of a day and rows without a key as before."""
    from dqflow.operators import timeline as TL

    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("i"), F.when(F.col("id") % 9 != 0, F.col("id") % 700).alias("k"), (F.col("id") % 13).alias("g"),
        F.when(F.col("id") % 7 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 90).cast("int"))).alias("d"), (F.col("id") % 3 == 0).alias("live"))
    many = rows.unionByName(rows.where("i % 2 = 0").withColumns({"k": F.lit(5).cast("long"), "i": F.concat("i", F.lit("x"))}))
    for df, coarse in ((rows, "g"), (rows, "k"), (many, "k")):
        keys = ["k"] if coarse == "k" else ["k", "g"]
        got = TL.flag_earlier_within(df, keys, "d", 3, "f", F.col("live"), "i", coarse)
        want = TL._earlier_by_day(df, keys, "d", 3, "f", F.col("live"), "i")
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert shuffles(TL._earlier_by_window(rows, ["k", "g"], "d", 3, "f", F.col("live"), "i")) == 1


def test_percentile_rows_do_not_travel(spark, sf):
    """the limits of few groups come to the rows, and both percentiles equal the separate ones."""
    from dqflow import shapes as S
    from dqflow.operators import joins as J

    rows = S.claims(spark, sf).select("claim_id", "procedure_code", "claim_amount").localCheckpoint()
    got = J.over_both_percentiles(rows)
    want = J.over_percentile(J.over_percentile(rows), by="procedure_code", name="over_group_p99")
    assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_amounts_meet_group_statistics_without_travelling(spark, monkeypatch):
    """F16: statistics of few groups are sent to the tasks, those of many are shuffled: the same rows."""
    from dqflow.operators import skew

    fact = spark.range(900).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 30).alias("k"))
    aggs = [F.avg("id").alias("m"), F.count(F.lit(1)).alias("n")]
    want = sorted(skew.attach_stats(fact, "k", aggs).collect(), key=str)
    few = skew.attach_stats(fact, "k", aggs, few=True)
    assert sorted(few.collect(), key=str) == want and shuffles(few) == 0
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    assert sorted(skew.attach_stats(fact, "k", aggs, few=True).collect(), key=str) == want


def test_boxes_give_the_path_lengths_of_the_trees(spark, monkeypatch):
    """points that look up their box score as those that walk down every tree."""
    from dqflow.operators import multivariate as M

    rows = spark.range(3000).select((F.col("id") * 37 % 101).alias("a"), (F.col("id") * F.col("id") % 977).cast("double").alias("b"), (F.col("id") % 2).alias("s"))
    boxed = {(r.x0, r.x1): (r.score, r.w, r.s) for r in M.isolation_scores(rows, ["a", "b"], trees=15, sums=["s"]).collect()}
    monkeypatch.setattr(M, "BOXES", 0)
    assert boxed == {(r.x0, r.x1): (r.score, r.w, r.s) for r in M.isolation_scores(rows, ["a", "b"], trees=15, sums=["s"]).collect()}
    assert sum(w for _, w, _ in boxed.values()) == 3000 and sum(s for _, _, s in boxed.values()) == 1500


def test_forest_stays_within_its_contamination(spark):
    """5772 rows put the interpolated limit between two ranks; the row above it made the share 10.01 percent."""
    from dqflow.operators import multivariate as M

    rows = spark.range(5772).select((F.col("id") * 7919 % 5772).alias("a"), (F.col("id") * F.col("id") % 5779).alias("b"))
    row = M.forest_summary(rows, ["a", "b"], trees=20).first()
    assert row["total_records"] == 5772 and 0 < row["anomaly_count"] <= 577


def test_z_curve_reads_the_table_once(spark, tmp_path):
    """ranks by halving equal the number of cut points up to the value; the rows are evaluated once."""
    from dqflow.sources import filetable as FT

    seen = spark.sparkContext.accumulator(0)

    def touched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(3000).select(F.col("id").alias("n"), F.concat(F.lit("m"), F.lpad((F.col("id") * 7 % 500).cast("string"), 4, "0")).alias("m"))
    cuts = FT.cut_points(rows, ["n", "m"])
    z = rows.select("n", "m", FT.morton(rows, ["n", "m"]).alias("z")).collect()
    for i, c in enumerate(("n", "m")):
        for r in z:
            rank = sum((r["z"] >> (2 * b + i) & 1) << b for b in range(FT.BITS))
            assert rank == sum(p <= r[c] for p in cuts[c]) * (2**FT.BITS - 1) // len(cuts[c])
    import datetime as dt

    FT.z_order(rows.mapInArrow(touched, rows.schema), str(tmp_path / "z"), ["n", "m"], 8, dt.datetime(2024, 1, 1))
    assert seen.value == 3000 and FT.read(spark, str(tmp_path / "z")).count() == 3000


def test_claims_do_not_travel_for_plans(spark, sf, monkeypatch):
    """member attributes meet the orders; above the joined feed nothing is shuffled, also when members are many."""
    from dqflow import shapes as S
    from dqflow.catalog import QUERIES
    from dqflow.catalog.quality import scored
    from dqflow.operators import skew
    from dqflow.plans import medallion as L

    columns = ["claim_id", "plan_type", "provider_name", "provider_state"]
    want = L.gold_claims(scored(spark, sf), S.members(spark, sf), S.providers(spark, sf), S.CLAIMS_AS_OF).select(*columns)
    assert want.where("plan_type is null").count() and want.where("plan_type is not null").count()
    monkeypatch.setattr(skew, "SMALL_ROWS", 50)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES["jn01_enriched_claims"](spark, sf)
        above, feed = got._jdf.queryExecution().executedPlan().toString().split("Union", 1)
        assert "Exchange hashpartitioning" not in above and "Exchange hashpartitioning(o_orderkey" in feed
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
