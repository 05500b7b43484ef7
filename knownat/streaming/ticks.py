"""The live stream: trade frames to 1-minute and 1-second bars.

Open and close follow arrival, so a late tick updates its own bar, however late it is.  A batch of ticks is folded to partial bars that
remember when their first and last tick arrived; partial bars of any number of batches fold to the bar.  The stream therefore keeps no state
and needs no watermark: nothing is too late, and nothing has to be held for what may still come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from knownat.sources.store import Folders

# The wire format of one trade record.
TRADE = "H0STCNT0"
WIDTH = 46
CODE, TIME, PRICE, CHANGE, VOLUME, DAY_VOLUME = 0, 1, 2, 5, 12, 13


def parse_frames(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """``0|type|count|f^f^...`` frames to one row per trade; other frames and bad records are skipped."""
    parts = F.split(F.col(raw), r"\|", 4)
    count = F.expr("try_cast(_parts[2] AS int)")
    whole = frames.withColumn("_parts", parts).where(
        (F.size("_parts") == 4) & (F.col("_parts")[0] == "0") & (F.col("_parts")[1] == TRADE)
    )
    body = whole.withColumn("_v", F.split(F.col("_parts")[3], r"\^")).withColumn("_n", count)
    # a short record ends the frame
    whole_records = F.least(F.col("_n"), F.floor(F.size("_v") / WIDTH).cast("int"))
    starts = F.when(whole_records > 0, F.sequence(F.lit(0), whole_records - 1)).otherwise(F.array().cast("array<int>"))
    rows = body.select(
        *[c for c in frames.columns if c != raw], "_v", F.explode(starts).alias("_k"),
    ).withColumn("_r", F.slice("_v", F.col("_k") * WIDTH + 1, F.lit(WIDTH)))

    def number(i: int, kind: str) -> Column:
        return F.expr(f"try_cast(_r[{i}] AS {kind})")

    out = rows.select(
        *[c for c in frames.columns if c != raw],
        F.col("_r")[CODE].alias("code"),
        F.col("_r")[TIME].alias("at"),
        number(PRICE, "double").alias("price"),
        number(VOLUME, "long").alias("volume"),
        number(DAY_VOLUME, "long").alias("day_volume"),
        number(CHANGE, "double").alias("change_pct"),
    )
    good = F.col("at").rlike(r"^([01]\d|2[0-3])[0-5]\d[0-5]\d$")
    for c in ("price", "volume", "day_volume", "change_pct"):
        good = good & F.col(c).isNotNull()
    return out.where(good)


def partial_bars(ticks: DataFrame, width: str) -> DataFrame:
    """What a batch of ticks knows of each (code, window): OHLCV, ticks, and the arrival of the first and last of them."""
    grouped = ticks.groupBy("code", F.window("ts", width).alias("_w"))
    return grouped.agg(
        F.min_by("price", "arrival").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "arrival").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"),
        F.min("arrival").alias("opened_by"), F.max("arrival").alias("closed_by"),
    ).select("code", F.col("_w.start").alias("start"), *_BAR, "opened_by", "closed_by")


_BAR = ("open", "high", "low", "close", "volume", "ticks")


def folded(partials: DataFrame) -> DataFrame:
    """Partial bars of any batches to one per (code, start); folding is associative, so folded ones can be folded again."""
    return partials.groupBy("code", "start").agg(
        F.min_by("open", "opened_by").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "closed_by").alias("close"),
        F.sum("volume").alias("volume"), F.sum("ticks").alias("ticks"), F.min("opened_by").alias("opened_by"), F.max("closed_by").alias("closed_by"))


def bars(ticks: DataFrame, width: str) -> DataFrame:
    """OHLCV per (code, window) of a table of ticks, with open and close by ``arrival``."""
    return partial_bars(ticks, width).select("code", "start", *_BAR)


class BarStore:
    """Where a stream's partial bars lie: a folder per batch, and base folders that hold the fold of all batches up to one.

    Writing a batch or a base again replaces its folder, so a replay after a lost executor or driver adds nothing twice.  A base counts once its
    ``_SUCCESS`` marker is there; a half-written one is never read.  Batches are only removed once a base that holds them is complete.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folders = Folders(spark, path)

    def write(self, ticks: DataFrame, batch: int, width: str) -> None:
        self.folders.write(partial_bars(ticks, width), "batch", batch)

    def parts(self) -> list[tuple[str, int]]:
        """What makes up the table now: the newest base and the batches after it."""
        bases = self.folders.complete("base")[-1:]
        return [("base", b) for b in bases] + [("batch", b) for b in self.folders.complete("batch") if b > max(bases, default=-1)]

    def partials(self) -> DataFrame | None:
        parts = self.parts()
        return self.folders.spark.read.parquet(*[self.folders.name(*p) for p in parts]) if parts else None

    def current(self) -> DataFrame | None:
        """The bars, every tick in its own; None before the first batch."""
        rows = self.partials()
        return None if rows is None else folded(rows).select("code", "start", *_BAR)

    def compact(self) -> None:
        """Folds everything into one base; then removes the batches and bases it holds."""
        batches, rows = self.folders.complete("batch"), self.partials()
        if rows is None or not batches:
            return
        self.folders.write(folded(rows), "base", batches[-1])
        for kind, upto in (("batch", batches[-1]), ("base", batches[-1] - 1)):
            for n in self.folders.complete(kind):
                if n <= upto:
                    self.folders.remove(kind, n)


#: Batches after which a running stream folds its store.
COMPACT_EVERY = 60


def start_bars(ticks: DataFrame, width: str, path: str, checkpoint: str, *, available_now: bool = False, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start the tick-to-bar job; offsets live in ``checkpoint``, so a restart resumes with the batch that was not finished."""
    store = BarStore(ticks.sparkSession, path)

    def save(batch: DataFrame, epoch: int) -> None:
        store.write(batch, epoch, width)
        if epoch and epoch % compact_every == 0:
            store.compact()

    writer = ticks.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")
    return writer.start()


def latest_per_code(bars_table: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of every code, oldest first."""
    w = W.partitionBy("code").orderBy(F.col("start").desc())
    return bars_table.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
