"""Queries R1-R8, B1-B11 and the intraday hypotheses."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from knownat.functions import numeric as num
from knownat.functions.numeric import day_text, key_day, rounded
from knownat.operators import intraday as intra
from knownat.operators import rules as rl
from knownat.operators import stats
from knownat.plans import fixtures as fx
from knownat.plans.intraday import market as market_days
from knownat.plans.registry import cte, query
from knownat.session import cut_lineage

TICK = "CASE WHEN {0} < 2000 THEN 1 WHEN {0} < 5000 THEN 5 WHEN {0} < 20000 THEN 10 WHEN {0} < 50000 THEN 50 WHEN {0} < 200000 THEN 100 WHEN {0} < 500000 THEN 500 ELSE 1000 END"


def tick(x):
    return f"({TICK.format(x)})"


def up(x):
    return f"(ceil({x} / {tick(x)} - 1e-9) * {tick(x)})"


def down(x):
    return f"(floor({x} / {tick(x)} + 1e-9) * {tick(x)})"


def below(x):
    return f"({down(x)} - {tick(down(x))})"


cte("hour", "SELECT *, max(open) FILTER (minute = 0) OVER (PARTITION BY instrument_id, day) AS e FROM mbars WHERE minute < 60 AND least(open, high, low, close) > 0", "mbars")


def hour(spark, sf):
    return rl.first_hour(fx.minute_bars(spark, sf))


@query("r1_ticks", "mbars", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, minute, CAST({tick('close')} AS BIGINT) AS tick, CAST({up('close')} AS DOUBLE) AS up, CAST({down('close')} AS DOUBLE) AS down, CAST({below('close')} AS DOUBLE) AS sell FROM mbars""")
def r1(spark, sf):
    return fx.minute_bars(spark, sf).select(*key_day(), "minute", num.tick("close").alias("tick"), num.round_up("close").alias("up"),
                                            num.round_down("close").alias("down"), num.sell_below("close").alias("sell"))


@query("r2_first_trade_as_open", "hour", """
SELECT instrument_id, CAST(day AS VARCHAR) AS day, CASE WHEN minute = min(minute) OVER (PARTITION BY instrument_id, day) THEN 0 ELSE minute END AS minute, close FROM hour""")
def r2(spark, sf):
    return rl.first_trade_as_open(hour(spark, sf)).select(*key_day(), "minute", "close")


def entry_sql(ticks):
    return f"""SELECT instrument_id, day, last / e - 1 AS r0, last / fill - 1 AS r_0905, CASE WHEN confirm > e THEN last / fill - 1 END AS r1, last / brk - 1 AS r2 FROM (
  SELECT instrument_id, day, any_value(e) AS e, arg_max(close, minute) AS last, arg_max(close, minute) FILTER (minute <= 4) AS confirm,
    arg_min(open + {ticks} * {tick('open')}, minute) FILTER (minute >= 5) AS fill,
    arg_min(greatest(h + {tick('h')}, open + {ticks} * {tick('open')}), minute) FILTER (minute BETWEEN 5 AND 29 AND high > h) AS brk
  FROM (SELECT *, max(CASE WHEN minute = 0 THEN open WHEN minute <= 4 THEN high END) OVER (PARTITION BY instrument_id, day) AS h FROM hour WHERE e > 0) GROUP BY 1, 2)"""


cte("entries", entry_sql(0), "hour")
RS = ["r0", "r_0905", "r1", "r2"]


@query("r3_r5_entries", "entries", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, {', '.join(f'round({r}, 8) AS {r}' for r in RS)} FROM entries")
def r35(spark, sf):
    return rl.entries(hour(spark, sf)).select(*key_day(), *[rounded(r, 8).alias(r) for r in RS])


@query("r4_entry_ticks", "hour", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, {', '.join(f'round({r}, 8) AS {r}' for r in RS)} FROM ({entry_sql(2)})")
def r4(spark, sf):
    return rl.entries(hour(spark, sf), entry_ticks=2).select(*key_day(), *[rounded(r, 8).alias(r) for r in RS])


def trigger_sql(take, stop):
    target = up(f"(e * {1 + take})")
    s = [f"CASE WHEN minute = 0 THEN NULL"]
    if stop is not None:
        s.append(f"WHEN open <= e * {1 - stop} THEN {below('open')} / e - 1")
    s.append(f"WHEN open >= {target} THEN {target} / e - 1")
    if stop is not None:
        s.append(f"WHEN low <= e * {1 - stop} THEN {below(f'(e * {1 - stop})')} / e - 1")
    s.append(f"WHEN high > {target} THEN {target} / e - 1 END")
    return " ".join(s)


ALL_RULES = [(t, s) for t in rl.TAKES for s in rl.STOPS]
MAIN = sorted({*ALL_RULES, (rl.TAKE, rl.STOP)}, key=str)


def rule_name(take, stop):
    return f"t{take * 1000:.0f}_s{'none' if stop is None else format(stop * 1000, '.0f')}"


cte("exits", "SELECT instrument_id, day, " + ", ".join(
    f"coalesce(arg_min(x_{rule_name(t, s)}, CASE WHEN x_{rule_name(t, s)} IS NOT NULL THEN minute END), arg_max(close, minute) / any_value(e) - 1) AS {rule_name(t, s)}" for t, s in MAIN)
    + " FROM (SELECT *, " + ", ".join(f"{trigger_sql(t, s)} AS x_{rule_name(t, s)}" for t, s in MAIN) + " FROM hour WHERE e > 0) GROUP BY 1, 2", "hour")


@query("r6_take_stop", "exits", "SELECT instrument_id, CAST(day AS VARCHAR) AS day, r.take, r.stop, round(r.v, 8) AS ret FROM (SELECT instrument_id, day, unnest(["
       + ", ".join(f"{{'take': {t}, 'stop': {'NULL::DOUBLE' if s is None else s}, 'v': {rule_name(t, s)}}}" for t, s in MAIN) + "]) AS r FROM exits)")
def r6(spark, sf):
    return rl.exits(hour(spark, sf), MAIN).select(*key_day(), "take", "stop", rounded("ret", 8).alias("ret"))


def reach_sql(take, stop=None):
    target = up(f"(e * {1 + take})")
    stop_gap = f"WHEN open <= e * {1 - stop} THEN 0" if stop else ""
    stop_low = f"WHEN low <= e * {1 - stop} THEN 0" if stop else ""
    return f"CASE WHEN minute = 0 THEN NULL {stop_gap} WHEN open >= {target} THEN 1 {stop_low} WHEN high > {target} THEN 1 END"


@query("r6_reached", "hour", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, CASE WHEN f25.w = 1 THEN f25.m END AS reach_25, CASE WHEN f50.w = 1 THEN f50.m END AS reach_50 FROM (
  SELECT instrument_id, day, min(CASE WHEN a IS NOT NULL THEN {{'m': minute, 'w': a}} END) AS f25, min(CASE WHEN b IS NOT NULL THEN {{'m': minute, 'w': b}} END) AS f50
  FROM (SELECT *, {reach_sql(0.025, 0.02)} AS a, {reach_sql(0.05, 0.02)} AS b FROM hour WHERE e > 0) GROUP BY 1, 2)""")
def r6b(spark, sf):
    return rl.reached_at(hour(spark, sf), (0.025, 0.05), stop=0.02).select(*key_day(), "reach_25", "reach_50")


R3 = rule_name(rl.TAKE, rl.STOP)
cte("rvals", f"""SELECT day, q.question, q.value FROM (SELECT day, unnest([{{'question': 'E1', 'value': avg(r1 - 0.003)}}, {{'question': 'D1''', 'value': avg(r1) - avg(r_0905)}}, {{'question': 'E2', 'value': avg(r2 - 0.003)}},
  {{'question': 'E3', 'value': avg(r3 - 0.003)}}, {{'question': 'D3', 'value': avg(r3 - r0)}}]) AS q FROM (SELECT n.*, x.{R3} AS r3 FROM entries n JOIN exits x USING (instrument_id, day)) GROUP BY day) WHERE q.value IS NOT NULL""", "entries", "exits")


def study_values(spark, sf):
    h = hour(spark, sf)
    return rl.study_values(rl.entries(h), rl.exits(h, [(rl.TAKE, rl.STOP)]))


@query("r7_day_values", "rvals", "SELECT CAST(day AS VARCHAR) AS day, question, round(value, 8) AS value FROM rvals")
def r7(spark, sf):
    return study_values(spark, sf).select(day_text("day").alias("day"), "question", rounded("value", 8).alias("value"))


def judge_sql(values, days, holdout, min_days, min_t, short=False):
    """The verdict gate over (question, day, value) rows; ``days`` lists all entry days."""
    limit = "AND n > " + str(holdout) if short else ""
    return f"""
SELECT coalesce(s.question, h.question) AS question, coalesce(days, 0) AS days, round(mean, 8) AS mean, round(t, 5) AS t, round(h1, 8) AS first_half, round(h2, 8) AS second_half, coalesce(holdout_days, 0) AS holdout_days, round(holdout_mean, 8) AS holdout_mean,
  CASE WHEN coalesce(days, 0) < {min_days} OR coalesce(holdout_days, 0) = 0 THEN 'not enough days' WHEN mean > 0 AND t >= {min_t} AND h1 > 0 AND h2 > 0 AND holdout_mean > 0 THEN 'established' ELSE 'not established' END AS state
FROM (SELECT question, count(*) AS days, avg(value) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(value) > 0 THEN avg(value) / (stddev_samp(value) / sqrt(count(*))) END AS t,
        avg(value) FILTER (rn <= n // 2) AS h1, avg(value) FILTER (rn > n // 2) AS h2 FROM (
        SELECT v.*, row_number() OVER (PARTITION BY question ORDER BY v.day) AS rn, count(*) OVER (PARTITION BY question) AS n FROM {values} v JOIN split_t USING (day) WHERE NOT held) GROUP BY 1) s
FULL JOIN (SELECT question, count(*) AS holdout_days, avg(value) AS holdout_mean FROM {values} JOIN split_t USING (day) WHERE held GROUP BY 1) h ON s.question = h.question""".replace(
        "split_t", f"(SELECT day, k <= {holdout} {limit} AS held FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM {days})))")


def judge_out(df):
    return df.select("question", "days", rounded("mean", 8).alias("mean"), rounded("t", 5).alias("t"), rounded("first_half", 8).alias("first_half"),
                     rounded("second_half", 8).alias("second_half"), "holdout_days", rounded("holdout_mean", 8).alias("holdout_mean"), "state")


cte("verdicts_r", judge_sql("rvals", "mbars", rl.HOLDOUT_DAYS, 10, rl.MIN_T), "rvals", "mbars")


def entry_verdicts(spark, sf):
    split = stats.split_days(fx.minute_bars(spark, sf).select("day"), rl.HOLDOUT_DAYS)
    return stats.judge(study_values(spark, sf), split, min_days=10, min_t=rl.MIN_T)


@query("r8_entry_verdicts", "verdicts_r", "SELECT * FROM verdicts_r")
def r8(spark, sf):
    return judge_out(entry_verdicts(spark, sf))


@query("r8_candidates", "verdicts_r", """
SELECT r.rule, r.ok AS candidate FROM (SELECT unnest([{'rule': 'R1', 'ok': coalesce(bool_and(state = 'established') FILTER (question IN ('E1', 'D1''')), false)}, {'rule': 'R2', 'ok': coalesce(bool_and(state = 'established') FILTER (question = 'E2'), false)},
  {'rule': 'R3', 'ok': coalesce(bool_and(state = 'established') FILTER (question IN ('E3', 'D3')), false)}]) AS r FROM verdicts_r)""")
def r8b(spark, sf):
    return rl.rule_candidates(entry_verdicts(spark, sf))


@query("r8_sensitivity", "rvals, entries, exits", f"""
WITH busy AS (SELECT day, count(*) AS n FROM entries GROUP BY 1), mid AS (SELECT median(n) AS m FROM busy)
SELECT question, CASE WHEN b.n > m THEN 'busy' ELSE 'quiet' END AS part, count(*) AS days, round(avg(value), 8) AS mean FROM rvals JOIN busy b USING (day), mid GROUP BY 1, 2""")
def r8c(spark, sf):
    from knownat.functions.scale import exact_quantile
    names = rl.entries(hour(spark, sf)).groupBy("day").agg(F.count(F.lit(1)).cast("double").alias("n"))
    middle = exact_quantile(names.withColumn("k", F.lit(0)), ["k"], "n", name="m").select("m")
    part = names.join(middle, F.col("n").isNotNull()).select("day", F.when(F.col("n") > F.col("m"), "busy").otherwise("quiet").alias("part"))
    return study_values(spark, sf).join(part, "day").groupBy("question", "part").agg(F.count(F.lit(1)).alias("days"), rounded(F.avg("value"), 8).alias("mean"))


# ---------------------------------------------------------------- laboratory samples
cte("member", """
SELECT s.instrument_id, s.day, s.return_pct, s.first_hour_pct, s.mfe_pct, s.open, s.close, (s.open / pc - 1) * 100 AS gap, (pc / ppc - 1) * 100 AS prev_change,
  CASE WHEN s.instrument_id % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, h, CASE WHEN h % 9 <> 0 THEN h * 1.0 END AS technical, 1 + (s.instrument_id * 4 + dayofyear(s.day)) % 40 AS rank,
  h / 10.0 AS volume_ratio, s.open AS price, CASE WHEN h % 10 = 9 THEN 'LOW_SCORE' END AS excluded,
  list_filter([CASE WHEN h % 2 = 0 THEN 'POSITIVE_NEWS_OVERLAY' END, CASE WHEN h % 11 = 0 THEN 'NEGATIVE_NEWS_OVERLAY' END, CASE WHEN h % 3 = 0 THEN 'DISCLOSURE_EVENT' END,
    CASE WHEN h % 5 = 0 THEN 'DISCOVERY_SURGE' END, CASE WHEN h % 7 = 0 THEN 'SEARCH_SURGE' END], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, lag(close) OVER w AS pc, lag(close, 2) OVER w AS ppc, (instrument_id * 17 + dayofyear(day) * 7) % 100 AS h FROM summary WINDOW w AS (PARTITION BY instrument_id ORDER BY day)) s""", "summary")


def members(spark, sf):
    w = W.partitionBy("instrument_id").orderBy("day")
    h = F.col("h")
    rows = intra.day_summary(fx.minute_bars(spark, sf)).withColumns({
        "pc": F.lag("close").over(w), "ppc": F.lag("close", 2).over(w), "h": (F.col("instrument_id") * 17 + F.dayofyear("day") * 7) % 100})
    flags = {"POSITIVE_NEWS_OVERLAY": 2, "NEGATIVE_NEWS_OVERLAY": 11, "DISCLOSURE_EVENT": 3, "DISCOVERY_SURGE": 5, "SEARCH_SURGE": 7}
    return rows.select(
        "instrument_id", "day", "return_pct", "first_hour_pct", "mfe_pct", "open", "close",
        num.percent_change("pc", "open").alias("gap"), num.percent_change("ppc", "pc").alias("prev_change"),
        F.when(F.col("instrument_id") % 2 == 0, "KOSPI").otherwise("KOSDAQ").alias("market"), "h",
        F.when(h % 9 != 0, h * F.lit(1.0)).alias("technical"), (F.lit(1) + (F.col("instrument_id") * 4 + F.dayofyear("day")) % 40).alias("rank"),
        (h / 10.0).alias("volume_ratio"), F.col("open").alias("price"), F.when(h % 10 == 9, "LOW_SCORE").alias("excluded"),
        F.array_compact(F.array(*[F.when(h % n == 0, k) for k, n in flags.items()])).alias("reasons"))


@query("b1_sample_tally", "member, mbars", """
SELECT CAST(day AS VARCHAR) AS day, why, count(*) AS n FROM (SELECT m.day, CASE WHEN m.h % 13 = 0 THEN 'partial' WHEN NOT x.has_open THEN 'no 09:00 bar' WHEN x.locked THEN 'locked' ELSE 'used' END AS why
FROM member m JOIN (SELECT instrument_id, day, bool_or(minute = 0) AS has_open, coalesce(max(greatest(open, high, low, close)) FILTER (minute < 30) = min(least(open, high, low, close)) FILTER (minute < 30), false) AS locked FROM mbars GROUP BY 1, 2) x USING (instrument_id, day)) GROUP BY 1, 2""")
def b1(spark, sf):
    bars = fx.minute_bars(spark, sf)
    flags = intra.half_hour_peak(bars).join(bars.groupBy("instrument_id", "day").agg(F.bool_or(F.col("minute") == 0).alias("has_open")), ["instrument_id", "day"])
    why = F.when(F.col("h") % 13 == 0, "partial").when(~F.col("has_open"), "no 09:00 bar").when(F.col("locked"), "locked").otherwise("used")
    return members(spark, sf).join(flags, ["instrument_id", "day"]).groupBy(day_text("day").alias("day"), why.alias("why")).agg(F.count(F.lit(1)).alias("n"))


def cut_sql(v, spec):
    edges, labels = spec
    return "CASE WHEN {0} IS NULL THEN NULL ".format(v) + " ".join(f"WHEN {v} < {e} THEN '{l}'" for e, l in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"


cte("sampled", f"""SELECT *, {cut_sql('gap', rl.GAP)} AS gap_bucket, {cut_sql('prev_change', rl.PREV)} AS prev_bucket, coalesce({cut_sql('technical', rl.SCORE)}, 'no score') AS technical_bucket,
  {cut_sql('rank', rl.RANK)} AS rank_bucket, {cut_sql('volume_ratio', rl.VOLUME)} AS volume_bucket, {cut_sql('price', rl.PRICE)} AS price_bucket, market || ' ' || {cut_sql('gap', rl.MARKET_GAP)} AS market_gap FROM member""", "member")
BK = ["gap_bucket", "prev_bucket", "technical_bucket", "rank_bucket", "volume_bucket", "price_bucket", "market_gap"]


@query("b2_buckets", "sampled", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, {', '.join(BK)} FROM sampled")
def b2(spark, sf):
    return rl.buckets(members(spark, sf)).select(*key_day(), *BK)


def stat_sql(source, keys, group=None):
    k = ", ".join(keys)
    return f"""SELECT {k}, CAST(sum(names) AS BIGINT) AS n, count(*) AS days, round(avg(value), 6) AS mean, round(CASE WHEN count(*) >= 2 AND stddev_samp(value) > 0 THEN avg(value) / (stddev_samp(value) / sqrt(count(*))) END, 4) AS t,
  round(avg(value) FILTER (rn <= c // 2), 6) AS first_half, round(CASE WHEN count(*) >= 2 THEN avg(value) FILTER (rn > c // 2) END, 6) AS second_half,
  CASE WHEN count(*) < 20 THEN 'too few days' WHEN (avg(value) FILTER (rn <= c // 2) > 0) = (avg(value) FILTER (rn > c // 2) > 0) THEN 'halves agree' ELSE 'halves differ' END AS flag
 FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY day) AS rn, count(*) OVER (PARTITION BY {k}) AS c FROM (SELECT {k}, day, avg(value) AS value, count(value) AS names FROM {source} GROUP BY {k}, day)) GROUP BY {k}"""


def stat_out(df, keys):
    return df.select(*keys, "n", "days", rounded("mean").alias("mean"), rounded("t", 4).alias("t"), rounded("first_half").alias("first_half"), rounded("second_half").alias("second_half"), "flag")


def long_sql(rules):
    return "unnest([" + ", ".join(f"{{'take': {t}, 'stop': {'NULL::DOUBLE' if s is None else s}, 'value': ({rule_name(t, s)} - 0.003) * 100}}" for t, s in rules) + "])"


cte("ruled", f"SELECT m.*, r.take, r.stop, r.value FROM (SELECT instrument_id, day, {long_sql(ALL_RULES)} AS r FROM exits) x JOIN sampled m USING (instrument_id, day)", "exits", "sampled")
cte("headlined", f"SELECT m.*, r.take, r.stop, r.value FROM (SELECT instrument_id, day, {long_sql(rl.HEADLINE)} AS r FROM exits) x JOIN sampled m USING (instrument_id, day)", "exits", "sampled")


@query("b3_rule_stats", "headlined, hour", f"""
SELECT s.*, round(h.hit, 6) AS hit25 FROM ({stat_sql('headlined', ['take', 'stop'])}) s, (SELECT avg(CASE WHEN f.w = 1 THEN 1.0 ELSE 0.0 END) AS hit FROM (
  SELECT min(CASE WHEN a IS NOT NULL THEN {{'m': minute, 'w': a}} END) AS f FROM (SELECT *, {reach_sql(0.025)} AS a FROM hour WHERE e > 0) GROUP BY instrument_id, day)) h""")
def b3(spark, sf):
    h = hour(spark, sf)
    long = rl.rule_long(members(spark, sf).select("instrument_id", "day"), rl.exits(h, rl.HEADLINE), rl.HEADLINE)
    hit = rl.reached_at(h, (0.025,)).agg(F.avg(F.when(F.col("reach_25").isNotNull(), 1.0).otherwise(0.0)).alias("hit25"))
    return stat_out(rl.rule_stats(long, ["take", "stop"]), ["take", "stop"]).join(hit.select(rounded("hit25").alias("hit25")), F.col("n").isNotNull())


@query("b4_grid", "ruled", stat_sql("(SELECT *, unnest(['all', market]) AS scope FROM ruled)", ["scope", "take", "stop"]))
def b4(spark, sf):
    return stat_out(rl.grid(members(spark, sf), rl.exits(hour(spark, sf), ALL_RULES)), ["scope", "take", "stop"])


FEATURES = ["market", "gap_bucket", "prev_bucket", "technical_bucket", "rank_bucket", "market_gap"]


def features():
    return {"reasons": F.col("reasons"), **{f: F.array(F.col(f)) for f in FEATURES}}


cte("labelled", "SELECT * FROM (SELECT *, 'reasons' AS feature, unnest(reasons) AS label FROM headlined " + " ".join(
    f"UNION ALL SELECT *, '{f}', {f} FROM headlined" for f in FEATURES) + ") WHERE label IS NOT NULL", "headlined")
cte("reached25", f"""SELECT instrument_id, day, CASE WHEN f.w = 1 THEN 1.0 ELSE 0.0 END AS hit FROM (SELECT instrument_id, day, min(CASE WHEN a IS NOT NULL THEN {{'m': minute, 'w': a}} END) AS f FROM (
  SELECT *, {reach_sql(0.025)} AS a FROM hour WHERE e > 0) GROUP BY 1, 2)""", "hour")


@query("b5_conditions", "labelled, reached25", f"""
SELECT s.*, round(h.hit25, 6) AS hit25 FROM ({stat_sql('labelled', ['feature', 'label', 'take', 'stop'])}) s JOIN (
  SELECT feature, label, avg(hit) AS hit25 FROM (SELECT DISTINCT instrument_id, day, feature, label FROM labelled) JOIN reached25 USING (instrument_id, day) GROUP BY 1, 2) h USING (feature, label)""")
def b5(spark, sf):
    h = hour(spark, sf)
    out = rl.conditions(rl.buckets(members(spark, sf)), rl.exits(h, rl.HEADLINE), rl.reached_at(h, (0.025,)), features())
    keys = ["feature", "label", "take", "stop"]
    return out.select(
        *keys, "n", "days", rounded("mean").alias("mean"), rounded("t", 4).alias("t"), rounded("first_half").alias("first_half"),
        rounded("second_half").alias("second_half"), "flag", rounded("hit25").alias("hit25"))


def forward_sql(source, sign="1", read=20, decide=60):
    return f"""SELECT question, count(*) AS days, round(avg(value), 6) AS mean, round(CASE WHEN count(*) >= 2 AND stddev_samp(value) > 0 THEN avg(value) / (stddev_samp(value) / sqrt(count(*))) END, 4) AS t,
  round(avg(value) FILTER (rn <= c // 2), 6) AS first_half, round(avg(value) FILTER (rn > c // 2), 6) AS second_half,
  CASE WHEN count(*) < {read} THEN 'not enough days' WHEN count(*) < {decide} THEN 'reading' WHEN avg(value) * max(sign) > 0 AND avg(value) / (stddev_samp(value) / sqrt(count(*))) * max(sign) >= 2
    AND avg(value) FILTER (rn <= c // 2) * max(sign) > 0 AND avg(value) FILTER (rn > c // 2) * max(sign) > 0 THEN 'established' ELSE 'not established' END AS state
 FROM (SELECT *, count(*) OVER (PARTITION BY question) AS c FROM (SELECT *, {sign} AS sign, row_number() OVER (PARTITION BY question ORDER BY day) AS rn FROM {source}) WHERE rn <= {decide}) GROUP BY 1"""


def forward_out(df):
    return df.select("question", "days", rounded("mean").alias("mean"), rounded("t", 4).alias("t"), rounded("first_half").alias("first_half"), rounded("second_half").alias("second_half"), "state")


@query("b6_forward_hypotheses", "ruled", forward_sql("""(SELECT 'S1' AS question, day, avg(value) AS value FROM ruled WHERE gap < -1 AND take = 0.05 AND stop = 0.01 GROUP BY day
  UNION ALL SELECT 'S2', day, avg(value) FROM ruled WHERE gap >= 1 AND take = 0.025 AND stop IS NULL GROUP BY day)""", "CASE WHEN question = 'S2' THEN -1 ELSE 1 END", 8, 12))
def b6(spark, sf):
    long = rl.rule_long(members(spark, sf).select("instrument_id", "day", "gap"), rl.exits(hour(spark, sf), rl.HEADLINE), rl.HEADLINE)
    q = F.when((F.col("gap") < -1) & (F.col("take") == 0.05), "S1").when((F.col("gap") >= 1) & (F.col("take") == 0.025) & F.col("stop").isNull(), "S2")
    daily = stats.day_means(long.withColumn("question", q).where("question IS NOT NULL"), ["question"], "value")
    return forward_out(stats.forward_judge(daily, sign=F.when(F.col("question") == "S2", -1).otherwise(1), read_days=8, decide_days=12))


cte("picked", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY technical DESC, rank) AS pick FROM member WHERE excluded IS NULL AND technical IS NOT NULL AND
  len(list_intersect(['POSITIVE_NEWS_OVERLAY', 'DISCLOSURE_EVENT', 'DISCOVERY_SURGE', 'SEARCH_SURGE'], reasons)) >= 2) WHERE pick <= 2""", "member")


@query("b7_pick_top", "picked", "SELECT CAST(day AS VARCHAR) AS day, pick, instrument_id FROM picked")
def b7(spark, sf):
    return rl.pick_top(members(spark, sf), need=2).select(day_text("day").alias("day"), F.col("pick").cast("long").alias("pick"), "instrument_id")


cte("peak", """SELECT instrument_id, day, (hi10 / e - 1) * 100 AS max_ten, max_ten_at, (hi / e - 1) * 100 AS max_day, max_day_at, (lo10 / e - 1) * 100 AS low_ten, (dip / e - 1) * 100 AS dip_before_peak, (last / e - 1) * 100 AS last, last_at FROM (
  SELECT instrument_id, day, any_value(e) AS e, any_value(p) AS max_day_at, max(high) AS hi, max(high) FILTER (minute < 60) AS hi10, arg_min(minute, CASE WHEN minute < 60 THEN row(-high, minute) END) AS max_ten_at,
    min(low) FILTER (minute < 60) AS lo10, min(low) FILTER (minute <= p) AS dip, arg_max(close, minute) AS last, max(minute) AS last_at FROM (
   SELECT *, arg_min(minute, row(-high, minute)) OVER (PARTITION BY instrument_id, day) AS p FROM (SELECT *, max(open) FILTER (minute = 0) OVER (PARTITION BY instrument_id, day) AS e FROM mbars) WHERE e > 0) GROUP BY 1, 2)""", "mbars")
PK = ["max_ten", "max_day", "low_ten", "dip_before_peak", "last"]


@query("b7_peaks", "peak", f"SELECT instrument_id, CAST(day AS VARCHAR) AS day, max_ten_at, max_day_at, last_at, {', '.join(f'round({c}, 6) AS {c}' for c in PK)} FROM peak")
def b7b(spark, sf):
    return rl.peak(fx.minute_bars(spark, sf)).select(*key_day(), "max_ten_at", "max_day_at", "last_at", *[rounded(c).alias(c) for c in PK])


@query("b7_share_judgement", "picked, reached25", forward_sql("""(SELECT 'S3' AS question, day, avg(hit) - 0.5 AS value FROM picked JOIN reached25 USING (instrument_id, day) GROUP BY day)""", "1", 8, 12))
def b7c(spark, sf):
    reached = rl.reached_at(hour(spark, sf), (0.025,)).withColumn("hit", F.when(F.col("reach_25").isNotNull(), 1.0).otherwise(0.0))
    rows = rl.pick_top(members(spark, sf), need=2).select("instrument_id", "day").join(reached, ["instrument_id", "day"])
    daily = stats.day_means(rows.withColumn("question", F.lit("S3")), ["question"], "hit").withColumn("value", F.col("value") - 0.5)
    return forward_out(stats.forward_judge(daily, read_days=8, decide_days=12, infinite_t=True))


@query("b7_reached_day", "mbars", f"""
SELECT instrument_id, CAST(day AS VARCHAR) AS day, min(minute) FILTER (r = 1) AS reached_at FROM (SELECT *, {reach_sql(0.03)} AS r FROM (
  SELECT *, max(open) FILTER (minute = 0) OVER (PARTITION BY instrument_id, day) AS e FROM mbars) WHERE e > 0) GROUP BY instrument_id, day""")
def b7d(spark, sf):
    return rl.reached_day(fx.minute_bars(spark, sf), 0.03).select(*key_day(), "reached_at")


PKB = cut_sql("{0}", ((5, 15, 30, 60), ("09:00-09:04", "09:05-09:14", "09:15-09:29", "09:30-09:59", "after 10:00")))


@query("b8_peak_buckets", "peak", f"""
SELECT {PKB.format('max_day_at')} AS bucket, count(*) AS n, round(avg(max_day), 6) AS mean_peak, round(avg(CASE WHEN max_day >= 2.5 THEN 1.0 ELSE 0.0 END), 6) AS share_25 FROM peak GROUP BY 1""")
def b8(spark, sf):
    return rl.peak(fx.minute_bars(spark, sf)).groupBy(rl.peak_bucket("max_day_at").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("max_day")).alias("mean_peak"), rounded(F.avg(F.when(F.col("max_day") >= 2.5, 1.0).otherwise(0.0))).alias("share_25"))


RX = ["n", "hit_10", "hit_60", "hit_minute", "low_before", "miss_at_10", "hit5_60", "gap_median"]


def reaction_sql(keys):
    return f"""SELECT {keys}, count(*) AS n, round(avg(CASE WHEN hit_25 < 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(CASE WHEN hit_25 IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_60, median(hit_25) AS hit_minute,
  round(avg(low_before_25) FILTER (hit_25 IS NOT NULL), 6) AS low_before, round(avg(at_10) FILTER (hit_25 IS NULL), 6) AS miss_at_10, round(avg(CASE WHEN hit_5 IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit5_60, round(median(gap), 6) AS gap_median FROM pathed GROUP BY {keys}"""


cte("pathed", "SELECT p.*, m.gap, 'D' || (m.h % 12) AS detail, 'G' || (m.h % 4) AS kind FROM path p JOIN member m USING (instrument_id, day)", "path", "member")


def pathed(spark, sf):
    tags = members(spark, sf).select("instrument_id", "day", "gap", F.concat(F.lit("D"), (F.col("h") % 12).cast("string")).alias("detail"),
                                     F.concat(F.lit("G"), (F.col("h") % 4).cast("string")).alias("kind"))
    return intra.early_path(fx.minute_bars(spark, sf)).join(tags, ["instrument_id", "day"])


@query("b9_reaction_stats", "pathed", reaction_sql("detail"))
def b9(spark, sf):
    out = rl.reaction_stats(cut_lineage(pathed(spark, sf)), ["detail"])
    return out.select("detail", *[F.col(c) if c == "n" else rounded(c).alias(c) for c in RX])


@query("b9_usual_reaction", "pathed, member", f"""
WITH d AS ({reaction_sql('detail')}), g AS ({reaction_sql('kind')})
SELECT a.instrument_id, CAST(a.day AS VARCHAR) AS day, CASE WHEN d.n >= 26 THEN 'same filing' WHEN g.n >= 26 THEN 'similar filings' END AS scope, CASE WHEN d.n >= 26 THEN d.n WHEN g.n >= 26 THEN g.n END AS n,
  CASE WHEN d.n >= 26 THEN d.hit_60 WHEN g.n >= 26 THEN g.hit_60 END AS hit_60 FROM (SELECT instrument_id, day, 'D' || (h % 12) AS detail, 'G' || (h % 4) AS kind FROM member) a LEFT JOIN d USING (detail) LEFT JOIN g USING (kind)""")
def b9b(spark, sf):
    paths = cut_lineage(pathed(spark, sf))
    asked = members(spark, sf).select("instrument_id", "day", F.concat(F.lit("D"), (F.col("h") % 12).cast("string")).alias("detail"),
                                      F.concat(F.lit("G"), (F.col("h") % 4).cast("string")).alias("kind"))
    out = rl.usual_reaction(asked, rl.reaction_stats(paths, ["detail"]), rl.reaction_stats(paths, ["kind"]), min_n=26)
    return out.select(*key_day(), "scope", "n", rounded("hit_60").alias("hit_60"))


cte("reviewed", """SELECT m.*, CASE m.h % 4 WHEN 0 THEN 'BUY_INTEREST' WHEN 1 THEN 'WATCH' WHEN 2 THEN 'CAUTION' END AS action, m.instrument_id = 9 AS heavyweight, k.market_return_pct AS mkt, h.peak_930, p.hit_25, p.at_10,
  CASE WHEN m.h % 3 = 0 THEN m.h % 6 END AS reports, CASE WHEN m.h % 17 = 0 THEN 'LOCKED' END AS prev_limit, CASE WHEN m.h % 3 = 0 THEN ['K' || (m.h % 2)] ELSE [] END AS kinds, CASE WHEN m.rank <= 3 THEN ['total'] ELSE [] END AS tops
 FROM member m JOIN market k USING (day) JOIN (SELECT instrument_id, day, (max(high) FILTER (minute < 30) / arg_min(open, minute) - 1) * 100 AS peak_930 FROM mbars GROUP BY 1, 2) h USING (instrument_id, day) LEFT JOIN path p USING (instrument_id, day)""", "member", "market", "mbars", "path")
GAPS = ((-2.0, 0.0, 2.0), ("gap under -2%", "gap -2..0%", "gap 0..+2%", "gap +2% and up"))


def review_rows(spark, sf):
    bars, h = fx.minute_bars(spark, sf), F.col("h")
    rows = members(spark, sf).drop("market").join(market_days(spark, sf).select("day", F.col("market_return_pct").alias("market")), "day")
    rows = rows.join(intra.half_hour_peak(bars).select("instrument_id", "day", "peak_930"), ["instrument_id", "day"])
    rows = rows.join(intra.early_path(bars).select("instrument_id", "day", "hit_25", "at_10"), ["instrument_id", "day"], "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "action": F.when(h % 4 == 0, "BUY_INTEREST").when(h % 4 == 1, "WATCH").when(h % 4 == 2, "CAUTION"), "heavyweight": F.col("instrument_id") == 9,
        "reports": F.when(h % 3 == 0, h % 6), "prev_limit": F.when(h % 17 == 0, "LOCKED"), "first_hour": F.col("first_hour_pct"), "open_close": F.col("return_pct"),
        "mfe": F.col("mfe_pct"), "kinds": F.when(h % 3 == 0, F.array(F.concat(F.lit("K"), (h % 2).cast("string")))).otherwise(none),
        "tops": F.when(F.col("rank") <= 3, F.array(F.lit("total"))).otherwise(none)})


RV = ["first_hour", "open_close", "vs_market", "peak_930", "hit25_10", "hit25_60", "miss_at10", "mfe_median"]


@query("b10_review_groups", "reviewed", f"""
SELECT grp, count(*) AS n, round(avg(first_hour_pct), 6) AS first_hour, round(avg(return_pct), 6) AS open_close, round(avg(return_pct - mkt), 6) AS vs_market, count(*) FILTER (return_pct > 0) AS up_close, round(avg(peak_930), 6) AS peak_930,
  count(*) FILTER (peak_930 >= 2) AS peak_930_2pct, round(avg(CASE WHEN at_10 IS NOT NULL THEN CASE WHEN hit_25 < 10 THEN 1.0 ELSE 0.0 END END), 6) AS hit25_10, round(avg(CASE WHEN at_10 IS NOT NULL THEN CASE WHEN hit_25 IS NOT NULL THEN 1.0 ELSE 0.0 END END), 6) AS hit25_60,
  round(avg(at_10) FILTER (hit_25 IS NULL), 6) AS miss_at10, round(median(mfe_pct), 6) AS mfe_median
FROM (SELECT *, unnest(list_filter(list_concat([CASE WHEN heavyweight THEN 'heavyweights' ELSE 'list' END, CASE WHEN NOT heavyweight THEN coalesce('out: ' || excluded, 'kept') END, CASE WHEN NOT heavyweight THEN 'action ' || coalesce(action, 'NONE') END,
    CASE WHEN NOT heavyweight AND reports > 0 THEN 'broker reports' WHEN NOT heavyweight AND reports = 0 THEN 'no broker reports' END, CASE WHEN NOT heavyweight THEN 'limit ' || prev_limit END,
    CASE WHEN NOT heavyweight THEN {cut_sql('gap', GAPS)} END, CASE WHEN heavyweight THEN NULL WHEN mkt > 0 THEN 'market up' WHEN mkt <= 0 THEN 'market down or flat' END],
    list_concat(CASE WHEN heavyweight THEN [] ELSE list_transform(reasons, lambda r: 'reason ' || r) END, list_concat(CASE WHEN heavyweight THEN [] ELSE list_transform(kinds, lambda r: 'filing ' || r) END, list_transform(tops, lambda r: 'top3 ' || r)))), lambda x: x IS NOT NULL)) AS grp FROM reviewed) GROUP BY 1""")
def b10(spark, sf):
    out = rl.review_stats(cut_lineage(rl.review_groups(review_rows(spark, sf))))
    return out.select("grp", "n", "up_close", "peak_930_2pct", *[rounded(c).alias(c) for c in RV])


@query("b11_lab_view", "ruled, headlined, labelled", f"""
SELECT 'grid' AS section, scope AS name, take, stop, n, days, mean, flag FROM ({stat_sql("(SELECT *, unnest(['all', market]) AS scope FROM ruled)", ['scope', 'take', 'stop'])})
UNION ALL SELECT 'conditions', feature || ': ' || label, take, stop, n, days, mean, flag FROM ({stat_sql('labelled', ['feature', 'label', 'take', 'stop'])})
UNION ALL SELECT 'daily', CAST(day AS VARCHAR), take, stop, count(*), 1, round(avg(value), 6), NULL FROM headlined GROUP BY day, take, stop""")
def b11(spark, sf):
    """Grid, conditions and the daily scorecard as one result set under ``section``."""
    h = hour(spark, sf)
    rows = rl.buckets(members(spark, sf))
    exits = rl.exits(h, ALL_RULES)
    cols = ["section", "name", "take", "stop", "n", "days", "mean", "flag"]
    grid = rl.grid(rows, exits).withColumns({"section": F.lit("grid"), "name": F.col("scope")})
    cond = rl.conditions(rows, exits, rl.reached_at(h, (0.025,)), features()).withColumns({"section": F.lit("conditions"), "name": F.concat("feature", F.lit(": "), "label")})
    daily = rl.rule_long(rows.select("instrument_id", "day"), exits, rl.HEADLINE).groupBy("day", "take", "stop").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    daily = daily.withColumns({"section": F.lit("daily"), "name": day_text("day"), "days": F.lit(1).cast("long"), "flag": F.lit(None).cast("string")})
    out = grid.select(*cols).unionByName(cond.select(*cols)).unionByName(daily.select(*cols))
    return out.withColumn("mean", rounded("mean"))


cte("hyp", """SELECT day, q.question, q.value FROM (SELECT day, unnest([
  {'question': 'H1', 'value': avg(return_pct) FILTER (list_contains(reasons, 'POSITIVE_NEWS_OVERLAY')) - avg(return_pct)}, {'question': 'H2', 'value': avg(return_pct) - avg(return_pct) FILTER (list_contains(reasons, 'NEGATIVE_NEWS_OVERLAY'))},
  {'question': 'H3', 'value': avg(first_hour_pct) FILTER (list_contains(reasons, 'SEARCH_SURGE')) - avg(first_hour_pct) FILTER (NOT list_contains(reasons, 'SEARCH_SURGE'))}, {'question': 'H4', 'value': avg(return_pct) FILTER (rank <= 10) - avg(return_pct) FILTER (rank > 10)},
  {'question': 'H5', 'value': avg(return_pct - mkt)}, {'question': 'H6', 'value': avg(first_hour_pct) FILTER (list_contains(reasons, 'DISCLOSURE_EVENT'))}, {'question': 'H7', 'value': avg(first_hour_pct)}]) AS q FROM reviewed GROUP BY day) WHERE q.value IS NOT NULL""", "reviewed")


@query("h4_list_hypotheses", "hyp", forward_sql("hyp", "1", 20, 25))
def h4(spark, sf):
    rows = review_rows(spark, sf)
    has = lambda r: F.array_contains("reasons", r)
    yes, oc, fh = F.lit(True), F.col("open_close"), F.col("first_hour")
    questions = {
        "H1": (has("POSITIVE_NEWS_OVERLAY"), yes, oc), "H2": (yes, has("NEGATIVE_NEWS_OVERLAY"), oc),
        "H3": (has("SEARCH_SURGE"), ~has("SEARCH_SURGE"), fh), "H4": (F.col("rank") <= 10, F.col("rank") > 10, oc),
        "H5": (yes, None, oc - F.col("market")), "H6": (has("DISCLOSURE_EVENT"), None, fh), "H7": (yes, None, fh)}
    return forward_out(stats.forward_judge(stats.paired_days(rows, questions), read_days=20, decide_days=25))
