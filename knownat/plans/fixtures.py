"""Views over the given tables in the shapes the operators read, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from knownat.operators import calendar as cal
from knownat.plans.registry import cte
from knownat.sources.tables import load

# ---------------------------------------------------------------- daily bars
cte(
    "bars",
    """
  SELECT CAST(l_suppkey % 8 AS BIGINT) AS instrument_id, CAST(l_shipdate AS DATE) AS day,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close,
         sum(l_quantity) AS volume
  FROM (SELECT *, 100 + l_extendedprice / l_quantity / 1000 AS price,
               row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k
        FROM lineitem WHERE isodow(l_shipdate) < 6)
  GROUP BY 1, 2""",
)


def bars(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").where(F.weekday("l_shipdate") < 5)
    price = F.lit(100) + F.col("l_extendedprice") / F.col("l_quantity") / 1000
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = rows.select(
        (F.col("l_suppkey") % 8).cast("long").alias("instrument_id"),
        F.to_date("l_shipdate").alias("day"),
        price.alias("price"),
        key.alias("k"),
        "l_quantity",
    )
    return rows.groupBy("instrument_id", "day").agg(
        F.min_by("price", "k").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "k").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


# ---------------------------------------------------------------- sessions
cte(
    "sess",
    """
  SELECT day, row_number() OVER (ORDER BY day) AS ordinal, lag(day) OVER (ORDER BY day) AS prev_day,
         lead(day) OVER (ORDER BY day) AS next_day, CAST(day AS TIMESTAMP) AS open_at,
         CAST(day AS TIMESTAMP) + INTERVAL 390 MINUTE AS close_at
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE isodow(l_shipdate) < 6)""",
)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    days = load(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).where(F.weekday("day") < 5)
    return cal.sessions_from_days(days)


cte(
    "spine",
    """
  SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(
      (SELECT min(day) FROM sess)::TIMESTAMP, (SELECT max(day) FROM sess)::TIMESTAMP, INTERVAL 1 DAY)) AS d)""",
    "sess",
)

# order days as the instants / days asked about
cte("asked", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders")


def asked_days(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


# ---------------------------------------------------------------- bar revisions
cte(
    "rev",
    """
  SELECT o_custkey AS instrument_id, l_orderkey AS bar_key,
         o_orderdate + to_days(CAST((l_linenumber * 7) % 30 AS INTEGER)) AS available_at,
         l_shipdate AS ingested_at, l_extendedprice AS close, l_extendedprice / l_quantity AS open,
         l_quantity AS volume, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("instrument_id"),
        F.col("l_orderkey").alias("bar_key"),
        F.timestamp_add("DAY", (F.col("l_linenumber") * 7) % 30, F.col("o_orderdate")).alias("available_at"),
        F.col("l_shipdate").alias("ingested_at"),
        F.col("l_extendedprice").alias("close"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("open"),
        F.col("l_quantity").alias("volume"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )


# ---------------------------------------------------------------- reported facts
CONCEPTS = (
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "NetIncomeLoss",
    "OperatingIncomeLoss",
    "EarningsPerShareBasic",
    "EarningsPerShareDiluted",
    "Assets",
    "Liabilities",
    "StockholdersEquity",
    "CashAndCashEquivalentsAtCarryingValue",
)
_LIST = ", ".join(f"'{c}'" for c in CONCEPTS)
cte(
    "fact",
    f"""
  SELECT instrument_id, concept, CASE WHEN idx BETWEEN 4 AND 5 THEN 'KRW/shares' ELSE 'KRW' END AS unit,
         CASE WHEN idx < 6 THEN make_date(yr, 1, 1) END AS period_start, make_date(yr, 12, 31) AS period_end,
         CASE idx WHEN 2 THEN px * 0.3 - 30000 WHEN 3 THEN px * 0.3 - 20000 WHEN 4 THEN px / 10000 - 8
              WHEN 5 THEN px / 10000 - 9 WHEN 7 THEN px * 0.5 WHEN 8 THEN px - 40000 ELSE px END AS value,
         filed_at, CAST(filed_at AS TIMESTAMP) + INTERVAL 1 DAY AS available_at,
         CAST(filed_at AS TIMESTAMP) + to_days(CAST(id % 40 AS INTEGER)) AS ingested_at, id,
         CASE WHEN instrument_id % 2 = 0 THEN 'SEC' ELSE 'DART' END AS source, CAST(id % 3 AS INTEGER) AS semantic_version
  FROM (SELECT *, [{_LIST}][idx + 1] AS concept FROM (
    SELECT o_custkey % 50 AS instrument_id, CAST((CAST(o_orderpriority[1] AS INTEGER) - 1) * 2 + o_orderkey % 2 AS INTEGER) AS idx,
           CAST(year(o_orderdate) - 1 AS INTEGER) AS yr, CAST(o_orderdate AS DATE) AS filed_at, o_totalprice AS px,
           o_orderkey AS id FROM orders))""",
)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    idx = ((F.substring("o_orderpriority", 1, 1).cast("int") - 1) * 2 + F.col("o_orderkey") % 2).cast("int")
    base = orders.select(
        (F.col("o_custkey") % 50).alias("instrument_id"),
        idx.alias("idx"),
        (F.year("o_orderdate") - 1).alias("yr"),
        F.to_date("o_orderdate").alias("filed_at"),
        F.col("o_totalprice").alias("px"),
        F.col("o_orderkey").alias("id"),
    )
    px = F.col("px")
    i = F.col("idx")
    value = (
        F.when(i == 2, px * 0.3 - 30000).when(i == 3, px * 0.3 - 20000).when(i == 4, px / 10000 - 8)
        .when(i == 5, px / 10000 - 9).when(i == 7, px * 0.5).when(i == 8, px - 40000).otherwise(px)
    )
    filed = F.col("filed_at").cast("timestamp")
    return base.select(
        "instrument_id",
        F.element_at(F.array(*[F.lit(c) for c in CONCEPTS]), i + 1).alias("concept"),
        F.when(i.between(4, 5), "KRW/shares").otherwise("KRW").alias("unit"),
        F.when(i < 6, F.make_date("yr", F.lit(1), F.lit(1))).alias("period_start"),
        F.make_date("yr", F.lit(12), F.lit(31)).alias("period_end"),
        value.alias("value"),
        "filed_at",
        (filed + F.expr("INTERVAL 1 DAY")).alias("available_at"),
        F.timestamp_add("DAY", (F.col("id") % 40).cast("int"), filed).alias("ingested_at"),
        "id",
        F.when(F.col("instrument_id") % 2 == 0, "SEC").otherwise("DART").alias("source"),
        (F.col("id") % 3).cast("int").alias("semantic_version"),
    )


cte(
    "filing",
    """
  SELECT o_custkey % 50 AS instrument_id,
         CASE o_orderkey % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-K/A' WHEN 2 THEN '[정정] 사업보고서 (' || year(o_orderdate) || '.12)'
              ELSE '주요사항보고서' END AS form,
         CAST(o_orderdate AS DATE) AS filed_at, make_date(CAST(year(o_orderdate) - 1 AS INTEGER), 12, 31) AS period_of_report,
         o_orderdate + INTERVAL 1 DAY AS available_at, CASE WHEN o_custkey % 50 % 2 = 0 THEN 'SEC' ELSE 'DART' END AS source, o_orderkey AS id
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)


def filings(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    k = F.col("o_orderkey") % 4
    form = (
        F.when(k == 0, "10-K").when(k == 1, "10-K/A")
        .when(k == 2, F.concat(F.lit("[정정] 사업보고서 ("), F.year("o_orderdate").cast("string"), F.lit(".12)")))
        .otherwise("주요사항보고서")
    )
    return rows.select(
        (F.col("o_custkey") % 50).alias("instrument_id"),
        form.alias("form"),
        F.to_date("o_orderdate").alias("filed_at"),
        F.make_date(F.year("o_orderdate") - 1, F.lit(12), F.lit(31)).alias("period_of_report"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("available_at"),
        F.when(F.col("o_custkey") % 50 % 2 == 0, "SEC").otherwise("DART").alias("source"),
        F.col("o_orderkey").alias("id"),
    )


# ---------------------------------------------------------------- minute bars
cte(
    "mbars",
    """
  SELECT instrument_id, day, minute, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, event_id) AS close, CAST(sum(floor(value)) + count(*) AS DOUBLE) AS volume
  FROM (SELECT CAST(user_id % 10 AS BIGINT) AS instrument_id, CAST(ts AS DATE) AS day, event_id, value, 10000 + value * 2 AS price,
               CAST(CASE WHEN hour(ts) < 12 THEN least(59, greatest(minute(ts) - 10, 0) * 60 // 49)
                    ELSE 60 + ((hour(ts) - 12) * 60 + minute(ts)) * 331 // 720 END AS BIGINT) AS minute FROM events)
  GROUP BY 1, 2, 3""",
)


def minute_bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per (instrument, day, minute since 09:00); at most 391 a day, however many ticks."""
    ticks = load(spark, sf, "events").select(
        (F.col("user_id") % 10).cast("long").alias("instrument_id"),
        F.to_date("ts").alias("day"),
        F.expr(
            "cast(CASE WHEN hour(ts) < 12 THEN least(59, greatest(minute(ts) - 10, 0) * 60 div 49) "
            "ELSE 60 + ((hour(ts) - 12) * 60 + minute(ts)) * 331 div 720 END as bigint)"
        ).alias("minute"),
        (F.lit(10000) + F.col("value") * 2).alias("price"),
        "value",
        "event_id",
    )
    return ticks.groupBy("instrument_id", "day", "minute").agg(
        F.min_by("price", "event_id").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "event_id").alias("close"),
        (F.sum(F.floor("value")) + F.count(F.lit(1))).cast("double").alias("volume"),
    )


# ---------------------------------------------------------------- events as readings, mentions, sweeps
cte(
    "evt",
    """
  SELECT event_id, user_id AS instrument_id, date_trunc('second', ts) AS seen_at, event_type, value,
         least(1.0, greatest(-1.0, (value - 50) / 500)) AS sentiment, (event_id % 10) / 10.0 AS intensity,
         ((event_id * 7) % 10) / 10.0 AS confidence FROM events""",
)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("instrument_id"),
        F.date_trunc("second", "ts").alias("seen_at"),
        "event_type",
        "value",
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("value") - 50) / 500)).alias("sentiment"),
        ((F.col("event_id") % 10) / 10.0).alias("intensity"),
        ((F.col("event_id") * 7 % 10) / 10.0).alias("confidence"),
    )


# ---------------------------------------------------------------- verdicts on query hits
cte(
    "hit",
    """
  SELECT doc_id AS hit_id, doc_id AS news_item_id, doc_id % 20 AS instrument_id, v AS rule_version,
         CASE WHEN quality = 1 THEN CASE WHEN v = 1 AND doc_id % 3 = 0 THEN 'PENDING' ELSE 'CONFIRMED' END
              WHEN doc_id % 5 = 0 THEN 'PENDING' ELSE 'REJECTED' END AS decision,
         CASE WHEN toxic = 1 AND v = 2 THEN 'MODEL' ELSE 'RULE' END AS decided_by,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_days(CAST(v * 2 AS INTEGER)) AS decided_at, doc_id * 10 + v AS id
  FROM labels, (VALUES (1), (2), (3)) t(v)""",
)


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "labels").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    doc, v = F.col("doc_id"), F.col("v")
    decision = F.when(
        F.col("quality") == 1, F.when((v == 1) & (doc % 3 == 0), "PENDING").otherwise("CONFIRMED")
    ).otherwise(F.when(doc % 5 == 0, "PENDING").otherwise("REJECTED"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return rows.select(
        doc.alias("hit_id"),
        doc.alias("news_item_id"),
        (doc % 20).alias("instrument_id"),
        v.alias("rule_version"),
        decision.alias("decision"),
        F.when((F.col("toxic") == 1) & (v == 2), "MODEL").otherwise("RULE").alias("decided_by"),
        F.timestamp_add("DAY", v * 2, F.timestamp_add("MINUTE", doc, start)).alias("decided_at"),
        (doc * 10 + v).alias("id"),
    )


# ---------------------------------------------------------------- symbol history
cte(
    "sym",
    """
  SELECT symbol, holder, valid_from, CAST(lead(valid_from) OVER (PARTITION BY symbol ORDER BY valid_from, holder) - INTERVAL 1 DAY AS DATE) AS valid_to
  FROM (SELECT CAST(o_custkey % 200 AS BIGINT) AS symbol, o_custkey AS holder, CAST(min(o_orderdate) AS DATE) AS valid_from FROM orders GROUP BY 1, 2)""",
)


def holders(spark: SparkSession, sf: str) -> DataFrame:
    """First day each holder was seen under a symbol."""
    return load(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % 200).alias("symbol"), F.col("o_custkey").alias("holder")
    ).agg(F.to_date(F.min("o_orderdate")).alias("valid_from"))


# ---------------------------------------------------------------- list candidates
cte(
    "cand",
    """
  SELECT CAST(p_size AS BIGINT) % 10 AS session_no, p_partkey AS instrument_id, p_partkey % 3 = 0 AS tracked,
         CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey * 31 % 101 - 50) / 20.0 END AS overlay_points,
         p_partkey % 7 = 0 AS has_disclosure_event, CASE WHEN p_partkey % 5 = 0 THEN p_size / 10.0 END AS search_surge,
         CASE WHEN p_partkey % 6 = 0 THEN p_retailprice / 300 END AS discovery_score,
         CASE WHEN p_partkey % 7 = 0 THEN (p_partkey % 10) / 10.0 END AS disclosure_intensity,
         CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey * 37 % 100) * 1.0 END AS judged_score,
         CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 13 % 60) - 30.0 END AS prev_change,
         CASE WHEN p_partkey % 8 = 0 THEN 'BUY_INTEREST' ELSE 'WATCH' END AS last_action,
         p_name, p_brand, p_type, p_retailprice FROM part""",
)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    return load(spark, sf, "part").select(
        (F.col("p_size").cast("long") % 10).alias("session_no"),
        key.alias("instrument_id"),
        (key % 3 == 0).alias("tracked"),
        F.when(key % 4 != 0, (key * 31 % 101 - 50) / 20.0).alias("overlay_points"),
        (key % 7 == 0).alias("has_disclosure_event"),
        F.when(key % 5 == 0, F.col("p_size") / 10.0).alias("search_surge"),
        F.when(key % 6 == 0, price / 300).alias("discovery_score"),
        F.when(key % 7 == 0, (key % 10) / 10.0).alias("disclosure_intensity"),
        F.when(key % 9 != 0, (key * 37 % 100) * F.lit(1.0)).alias("judged_score"),
        F.when(key % 11 != 0, (key * 13 % 60) - F.lit(30.0)).alias("prev_change"),
        F.when(key % 8 == 0, "BUY_INTEREST").otherwise("WATCH").alias("last_action"),
        "p_name", "p_brand", "p_type", "p_retailprice",
    )


def hhmm(minute: Column | str) -> Column:
    """Minutes since 09:00 as a local ``HHMM`` label."""
    m = (F.col(minute) if isinstance(minute, str) else minute) + 540
    return F.concat(F.lpad((m / 60).cast("int").cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))
