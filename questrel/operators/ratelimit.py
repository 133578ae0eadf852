"""Sliding rate estimate over two windows, and the ban that brings a key back to its target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(calls: DataFrame, key: str, t: str, x: str, seq: str, target: int, window: int) -> DataFrame:
    """Adds w0, w1 and scaled_ban to calls in order of seq; target is the number allowed a window (integer).

    With u the time in seconds, W the window and W0, W1 what the last and the current window have counted,
    usage = (W - u mod W) * W0 + W * W1, and scaled_ban = usage - W * target, 0 at least: W times the ban in
    seconds, exactly. The first call after a gap of two windows or more starts anew and isn't counted itself;
    nor is a key's first. Times must not fall with seq; if they do, calls count for the latest window so far.
    """
    order = Window.partitionBy(key).orderBy(seq)
    w = F.lit(window)
    # the latest window so far stands for calls that come late
    d = calls.withColumn("_e", F.max(F.expr(f"{t} div {window}")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_p", F.lag("_e").over(order))
    counted = F.when(F.col("_p").isNull() | (F.col("_e") > F.col("_p") + 1), F.lit(0)).otherwise(F.col(x))
    inside = Window.partitionBy(key, "_e").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_c", counted.cast("long")).withColumn("w1", F.sum("_c").over(inside))
    totals = Window.partitionBy(key).orderBy("_e").rangeBetween(-1, -1)
    d = d.withColumn("w0", F.coalesce(F.sum("_c").over(totals), F.lit(0)))
    usage = (w - F.col(t) % w) * F.col("w0") + w * F.col("w1")
    return d.withColumn("scaled_ban", F.greatest(usage - w * F.lit(target), F.lit(0)).cast("long")).drop("_e", "_p", "_c")


class RateLimit:
    """The same for one key, a call at a time, in single precision; count() gives the ban in seconds."""

    def __init__(self, target: float, window: int):
        import numpy as np

        self.f, self.target, self.window = np.float32, np.float32(target), window
        self.epoch = self.w0 = self.w1 = 0

    def count(self, unix: int, x: int) -> float:
        f, epoch = self.f, unix // self.window
        if epoch > self.epoch:
            follows = epoch == self.epoch + 1
            self.w0, self.w1, self.epoch = (self.w1, x, epoch) if follows else (0, 0, epoch)
        else:
            self.w1 += x
        share = f(1) - f(unix % self.window) / f(self.window)
        rate = (share * f(self.w0) + f(self.w1)) / f(self.window)
        return max(0.0, float(f(self.window) * (rate - self.target)))
