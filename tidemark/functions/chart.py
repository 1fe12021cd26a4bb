"""What a price chart draws, as windows and column functions: axes with round ticks, days of the time axis, end labels that don't overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The drawing's frame and the least distance of two labels, in its units.
VIEW_WIDTH, PLOT_LEFT, PLOT_RIGHT, PLOT_TOP, PLOT_BOTTOM, AXIS_Y = 760.0, 64.0, 720.0, 24.0, 288.0, 300.0
LABEL_GAP, LABEL_RIGHT, LABEL_DOWN, CHAR_WIDTH, LABEL_MARGIN = 13.0, 4.0, 3.5, 6.3, 6.0
TICKS, PAD, FLAT_PAD = 4, 0.06, 0.1


def nice_step(span: Column, count: int = TICKS) -> Column:
    """The round step (1, 2, 5 or 10 times a power of ten) next to a part of the span."""
    part = span / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(part)))
    share = part / power
    return F.when(share < 1.5, 1.0).when(share < 3, 2.0).when(share < 7, 5.0).otherwise(10.0) * power


def ticks_within(low: Column, high: Column, count: int = TICKS) -> Column:
    """The multiples of a round step within [low, high]; their middle if there are none, low if the span is empty."""
    step = nice_step(high - low, count)
    first = F.ceil(low / step).cast("double") * step
    n = F.floor((high + 1e-9 - first) / step).cast("int")
    some = F.transform(F.sequence(F.lit(0), n), lambda i: F.round(first + i * step, 2))
    return F.when(high <= low, F.array(F.round(low, 0))).when(n < 0, F.array(F.round((low + high) / 2, 2))).otherwise(some)


def price_axis(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y_min, y_max, ticks): the price axis of each chart of points(keys, price): its span with room above and below, more if all prices are one."""
    low, high = F.min("price").cast("double"), F.max("price").cast("double")
    per = points.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"))
    pad = F.when(F.col("_low") == F.col("_high"), F.greatest(F.abs("_low") * FLAT_PAD, F.lit(1.0))).otherwise((F.col("_high") - F.col("_low")) * PAD)
    rows = per.select(*keys, (F.col("_low") - pad).alias("y_min"), (F.col("_high") + pad).alias("y_max"))
    return rows.withColumn("ticks", ticks_within(F.col("y_min"), F.col("y_max")))


def time_axis(points: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """(keys, t0, t1, labels): from the first day, or the day before `now` if that is not earlier, to `now`; 4, 5 or 7 labels at equal distances, with the year from a year on."""
    first = F.min("day").cast("timestamp_ntz")
    rows = points.groupBy(*keys).agg(first.alias("t0")).withColumn("t1", now.cast("timestamp_ntz"))
    rows = rows.withColumn("t0", F.when(F.col("t0") >= F.col("t1"), F.col("t1") - F.expr("interval '1' day")).otherwise(F.col("t0")))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    span = seconds("t1") - seconds("t0")
    n = F.when(span <= 14 * 86400, 4).when(span <= 45 * 86400, 5).otherwise(7)
    at = lambda i: F.timestamp_seconds(seconds("t0") + span * i / (n - 1)).cast("timestamp_ntz")
    label = lambda t: F.upper(F.when(span >= 365 * 86400, F.date_format(t, "MMM ''yy")).otherwise(F.date_format(t, "MMM d")))
    return rows.withColumn("labels", F.transform(F.sequence(F.lit(0), n - 1), lambda i: label(at(i))))


def end_labels(last: DataFrame, keys: list[str], bottom: float = AXIS_Y, gap: float = LABEL_GAP) -> DataFrame:
    """last(keys, label, y, ...) with `placed`: labels at the ends of a chart's lines, in their order, moved so that neighbours are `gap` apart and none is below the axis.

    Downwards each label is pushed by the one above it: the running maximum of y - k*gap, plus k*gap for the k-th. Then, from the lowest one up, each is pushed back by the axis and the one
    below it: the running minimum of the same from the other end. So a fold over ordered labels is two windows.
    """
    order = Window.partitionBy(*keys).orderBy("y", "label")
    rows = last.withColumn("_k", (F.row_number().over(order) - 1) * F.lit(gap))
    down = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_down", F.max(F.col("y") - F.col("_k")).over(down) + F.col("_k"))
    return rows.withColumn("placed", F.round(F.min(F.least("_down", F.lit(bottom)) - F.col("_k")).over(up) + F.col("_k"), 2)).drop("_k", "_down")


def scaled_y(price: Column, y_min: Column, y_max: Column) -> Column:
    """Where a price stands in the frame."""
    return PLOT_TOP + (y_max - price) / (y_max - y_min) * (PLOT_BOTTOM - PLOT_TOP)


def scaled_x(at: Column, t0: Column, t1: Column) -> Column:
    """Where an instant stands in the frame."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return PLOT_LEFT + (seconds(at) - seconds(t0)) / (seconds(t1) - seconds(t0)) * (PLOT_RIGHT - PLOT_LEFT)


def view_width(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, width): how wide a chart must be for its labels(keys, label, x)."""
    right = F.col("x") + F.length("label") * CHAR_WIDTH + LABEL_MARGIN
    return labels.groupBy(*keys).agg(F.round(F.greatest(F.lit(VIEW_WIDTH), F.max(right)), 0).cast("long").alias("width"))
