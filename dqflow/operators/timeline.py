"""Look-back conditions over time that never sort a whole key in one task.

Rows are folded to one row per key and day (or other slot) first, so a window
per key sees at most as many rows as there are slots in the history, however
many rows the key holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqflow.operators.skew import HOT_SHARE, all_not_null, as_list, attach_stats, hot_keys, join_unique
from dqflow.sources.tables import stored_layer


def trailing_count(df: DataFrame, keys, day: str, days: int, name: str) -> DataFrame:
    """Rows per key in the ``days`` ending at each active day, one row per day."""
    keys = as_list(keys)
    daily = df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long")
    frame = W.partitionBy(*keys).orderBy(number).rangeBetween(-days, 0)
    return daily.withColumn(name, F.sum("_n").over(frame)).drop("_n")


def trailing_distinct(df: DataFrame, keys, day: str, value: str, days: int, name: str) -> DataFrame:
    """Distinct values per key in the trailing window, exact.

    Each value covers ``days + 1`` days from every appearance; cutting that
    cover at the value's next appearance leaves disjoint spells, so the distinct
    count is a running sum of spell starts minus ends.
    """
    keys = as_list(keys)
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, value, day).agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.withColumn("_next", F.lead(day).over(W.partitionBy(*keys, value).orderBy(day)))
    stop = F.least(F.coalesce("_next", F.date_add(day, days + 1)), F.date_add(day, days + 1))
    spells = seen.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(day).alias("_d"), F.lit(1).alias("_delta"), F.lit(1).alias("_active")),
                F.struct(stop.alias("_d"), F.lit(-1).alias("_delta"), F.lit(0).alias("_active")),
            )
        ).alias("s"),
    ).select(*keys, "s.*")
    daily = spells.groupBy(*keys, "_d").agg(F.sum("_delta").alias("_delta"), F.max("_active").alias("_active"))
    running = W.partitionBy(*keys).orderBy("_d").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        daily.withColumn(name, F.sum("_delta").over(running))
        .where("_active = 1")
        .select(*keys, F.col("_d").alias(day), name)
    )


def interval_cover(df: DataFrame, keys, start: str, end: str, open_end) -> DataFrame:
    """Merge overlapping intervals; one row per key with a sorted ``cover`` array.

    NULL ends become ``open_end``.  Folding to one row per key and start day
    first bounds every key by the number of days in the calendar.
    """
    keys = as_list(keys)
    folded = (
        df.where(F.col(start).isNotNull())
        .groupBy(*keys, F.col(start).alias("_s"))
        .agg(F.max(F.coalesce(F.col(end), F.lit(open_end))).alias("_e"))
        .where("_e >= _s")
    )
    order = W.partitionBy(*keys).orderBy("_s")
    before = F.max("_e").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = folded.withColumn("_new", F.when(before.isNull() | (F.col("_s") > before), 1).otherwise(0)).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    merged = islands.groupBy(*keys, "_island").agg(F.min("_s").alias("s"), F.max("_e").alias("e"))
    return merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cover"))


def covered(cover: Column, day: Column) -> Column:
    return F.coalesce(F.exists(cover, lambda i: (day >= i["s"]) & (day <= i["e"])), F.lit(False))


def flag_covered(fact: DataFrame, intervals: DataFrame, keys, day, start, end, open_end, name, **kw) -> DataFrame:
    """Boolean: some interval of the key contains the row's day."""
    cover = interval_cover(intervals, keys, start, end, open_end)
    out = join_unique(fact, cover, keys, "left", **kw)
    return out.withColumn(name, covered(F.col("cover"), F.col(day))).drop("cover")


def flag_covered_by(fact: DataFrame, named: dict, keys, day, start, end, open_end, facts: DataFrame | None = None, **kw) -> DataFrame:
    """A boolean per name: some interval of that table's rows of the key contains the row's day.

    ``facts`` (one row per key) comes along: everything known by the key is one look-up, so the rows travel once for all.
    """
    keys = as_list(keys)
    sides = [] if facts is None else [facts]
    sides += [interval_cover(df, keys, start, end, open_end).withColumnRenamed("cover", f"_cover_{name}") for name, df in named.items()]
    out = join_unique(fact, reduce(lambda a, b: a.join(b, keys, "full"), sides), keys, "left", **kw)
    return out.withColumns({name: covered(F.col(f"_cover_{name}"), F.col(day)) for name in named}).drop(*[f"_cover_{name}" for name in named])


def hot_groups(df: DataFrame, keys, coarse: str) -> DataFrame | None:
    """Keys with more than their share of the rows (see ``skew``), or None.

    A hot key is one of a hot value of its column ``coarse``, so whole keys are counted among the rows of such values only.
    """
    hot = stored_layer(hot_keys(df, coarse), "hot-values")
    if hot.isEmpty():
        return None
    counts = df.join(F.broadcast(hot), coarse, "left_semi").where(all_not_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    limit = df.select(F.count(F.lit(1))).scalar() / (HOT_SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = stored_layer(counts.where(F.col("_rows") > limit).select(*keys), "hot-groups")
    return None if found.isEmpty() else found


def flag_earlier_within(df: DataFrame, keys, at: str, days: int, name: str, counts: Column | None = None,
                        ident: str | None = None, coarse: str | None = None) -> DataFrame:
    """Is there another row of the same key at most ``days`` earlier?

    ``at`` is a date.  Only rows satisfying ``counts`` are looked for.  Rows on
    the same day see each other when they carry a different ``ident``; without
    ``ident`` only strictly earlier days count.  Rows travel once, by key; rows of hot keys are folded to one row
    per key and day instead.  ``coarse`` is a key column with few values (the first one by default) that tells where to look for hot keys.
    """
    keys = as_list(keys)
    hot = hot_groups(df, keys, coarse or keys[0])
    if hot is None:
        return _earlier_by_window(df, keys, at, days, name, counts, ident)
    few = _earlier_by_window(df.join(F.broadcast(hot), keys, "left_anti").select(*df.columns), keys, at, days, name, counts, ident)
    many = df.join(F.broadcast(hot), keys, "left_semi").select(*df.columns)
    return few.unionByName(_earlier_by_day(many, keys, at, days, name, counts, ident))


def _earlier_by_window(df, keys, at, days, name, counts, ident):
    """Running maximum of the days before and extremes of the day itself: one shuffle and one sort by key and day."""
    whole = all_not_null([*keys, at])
    rows = df.withColumns({
        # Rows without a whole key meet nobody and are spread.
        "__salt": F.when(whole, F.lit(0).cast("long")).otherwise(F.spark_partition_id().cast("long") + 1),
        "__day": F.unix_date(at), "__live": F.lit(True) if counts is None else counts})
    group = W.partitionBy("__salt", *keys)
    before = group.orderBy("__day").rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__prev", F.max(F.when(F.col("__live"), F.col("__day"))).over(before))
    found = F.coalesce(F.col("__day") - F.col("__prev") <= days, F.lit(False))
    if ident:
        same_day, shown = W.partitionBy("__salt", *keys, "__day"), F.when(F.col("__live"), F.col(ident))
        rows = rows.withColumns({"__lo": F.min(shown).over(same_day), "__hi": F.max(shown).over(same_day)})
        found = found | (F.col("__lo") != F.col(ident)) | (F.col("__hi") != F.col(ident))
    return rows.withColumn(name, (F.col("__salt") == 0) & F.coalesce(found, F.lit(False))).select(*df.columns, name)


def _earlier_by_day(df, keys, at, days, name, counts, ident):
    """One row per key and day, joined back on key and day: no key is ever gathered."""
    who = F.col(ident) if ident else F.lit(0)
    shown = who if counts is None else F.when(counts, who)
    daily = df.groupBy(*keys, at).agg(F.min(shown).alias("_lo"), F.max(shown).alias("_hi"))
    before = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    last_day = F.last(F.when(F.col("_lo").isNotNull(), F.col(at)), ignorenulls=True).over(before)
    present = daily.withColumn("_prev", last_day)
    out = join_unique(df, present, [*keys, at], "left")
    earlier = F.datediff(F.col(at), F.col("_prev")) <= days
    if ident:
        earlier = F.coalesce(earlier, F.lit(False)) | (F.col("_lo") != F.col(ident)) | (F.col("_hi") != F.col(ident))
    return out.withColumn(name, F.coalesce(earlier, F.lit(False))).drop("_lo", "_hi", "_prev")


def flag_not_first(df: DataFrame, keys, order: list, name: str, **kw) -> DataFrame:
    """True for rows that have a strictly smaller row (by ``order``) of the same key.

    Only groups of two rows and more are joined back, the others hold no such row.
    """
    keys = as_list(keys)
    out = attach_stats(df, keys, [F.min(F.struct(*order)).alias("_first")], group_rows=2, **kw)
    return out.withColumn(name, F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))).drop("_first")


#: Rows that a slot of one key should hold at most.
SLOT_ROWS = 50_000
HOUR_MICROS = 3_600_000_000


def even_slot_width(df: DataFrame, keys, at_micros: Column, rows_per_slot: int = SLOT_ROWS) -> int:
    """Width in microseconds at which no slot of a key holds many more than ``rows_per_slot`` rows.

    Starts from an hour and narrows by what the fullest slot holds, so a slot's size follows the rows and not the clock.
    Each look is one combining count per key and slot; only rows of one microsecond stay together for good.
    """
    keys, width = as_list(keys), HOUR_MICROS
    rows = df.select(*keys, at_micros.alias("_t"))
    while width > 1:
        counts = rows.groupBy(*keys, F.floor(F.col("_t") / width).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 2 * rows_per_slot:
            break
        width = max(1, width // -(-most // rows_per_slot))
    return width


def even_slot(df: DataFrame, keys, at_micros: Column, rows_per_slot: int = SLOT_ROWS) -> Column:
    """The slot of each row, of the width that ``even_slot_width`` finds."""
    return F.floor(at_micros / even_slot_width(df, keys, at_micros, rows_per_slot))


def lag_in_slots(df: DataFrame, keys, at: str, slot: Column, order: list, value: str, name: str) -> DataFrame:
    """``lag(value)`` per key in the given order, computed slot by slot.

    Inside a slot an ordinary window does the work; the first row of a slot takes
    the last value of the key's previous non-empty slot, found on one summary row
    per key and slot.
    """
    keys = as_list(keys)
    rows = df.withColumn("_slot", slot)
    inner = W.partitionBy(*keys, "_slot").orderBy(*order)
    rows = rows.withColumns({"_lag": F.lag(value).over(inner), "_pos": F.row_number().over(inner)})
    tail = rows.groupBy(*keys, "_slot").agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    tail = tail.withColumn("_before", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_slot"))).drop("_tail")
    out = rows.join(tail, [*keys, "_slot"], "left")
    return out.withColumn(name, F.when(F.col("_pos") == 1, F.col("_before")).otherwise(F.col("_lag"))).drop(
        "_slot", "_lag", "_pos", "_before"
    )


def sequence_in_slots(df: DataFrame, keys, slot: Column, order: list, name: str) -> DataFrame:
    """Row number per key in the given order, numbered slot by slot."""
    keys = as_list(keys)
    rows = df.withColumn("_slot", slot)
    rows = rows.withColumn("_pos", F.row_number().over(W.partitionBy(*keys, "_slot").orderBy(*order)))
    sizes = rows.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    out = rows.join(sizes, [*keys, "_slot"])
    return out.withColumn(name, F.col("_offset") + F.col("_pos")).drop("_slot", "_pos", "_offset")


def last_before_in_slots(df: DataFrame, keys, slot: Column, order: list, value: Column, name: str) -> DataFrame:
    """Last non-NULL ``value`` of the key strictly before the row, slot by slot."""
    keys = as_list(keys)
    rows = df.withColumns({"_slot": slot, "_v": value})
    inner = W.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inner))
    tail = rows.groupBy(*keys, "_slot").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail")
    )
    earlier = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    tail = tail.withColumn("_before", F.last("_tail", ignorenulls=True).over(earlier)).drop("_tail")
    out = rows.join(tail, [*keys, "_slot"])
    return out.withColumn(name, F.coalesce("_in", "_before")).drop("_slot", "_v", "_in", "_before")


def trailing_in_slots(df: DataFrame, keys, at_micros: Column, seconds: int, name: str, rows_per_slot: int = SLOT_ROWS) -> DataFrame:
    """Rows of the key in the ``seconds`` up to and including each row, exact.

    The count is the key's running count at the row minus that at a marker one width earlier.  Running counts are
    taken slot by slot, with the sum of all earlier slots added, so slots may be far narrower than the window.
    """
    keys = as_list(keys)
    width = seconds * 1_000_000
    fine = even_slot_width(df, keys, at_micros, rows_per_slot)
    t = df.select("*", at_micros.alias("_t")).withColumn("_s", F.floor(F.col("_t") / fine))
    t = t.withColumn("_rid", F.row_number().over(W.partitionBy(*keys, "_s").orderBy("_t")))
    row, nothing = F.struct(*df.columns), F.lit(None).cast(df.schema)

    def part(at, event, payload, own):
        return F.struct(
            F.floor(at / fine).alias("slot"), at.alias("at"), F.lit(event).alias("event"), F.col("_s").alias("home"),
            F.col("_rid").alias("rid"), payload.alias("row"), F.lit(own).alias("own"),
        )

    shown = t.select(*keys, F.inline(F.array(part(F.col("_t"), 1, row, True), part(F.col("_t") - width, 0, nothing, False))))
    before = W.partitionBy(*keys).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    sums = shown.groupBy(*keys, "slot").agg(F.sum("event").alias("_sum"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    grow = W.partitionBy(*keys, "slot").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = shown.withColumn("_in", F.sum("event").over(grow)).join(offsets, [*keys, "slot"]).withColumn("_run", F.col("_in") + F.col("_offset"))
    pairs = counted.groupBy(*keys, "home", "rid").agg(
        F.any_value("row", F.lit(True)).alias("row"),
        (F.max(F.when(F.col("own"), F.col("_run"))) - F.max(F.when(~F.col("own"), F.col("_run")))).alias(name),
    )
    return pairs.select("row.*", name)
