"""Stored tables: schemas and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; zone-less timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in naive else F.col(c) for c in df.columns])


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """Append rows to a table folder; corrections are new rows, never updates."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


_PRICE = "open decimal(38,10), high decimal(38,10), low decimal(38,10), close decimal(38,10)"

#: Column lists of the stored tables the operators read and write.
SCHEMAS: dict[str, str] = {
    "instrument": "instrument_id long, market string, name string, sector string, listing string, tracked boolean, "
    "listed_at date, delisted_at date, us_cik string, kr_corp_code string, ingested_at timestamp",
    "symbol_history": "instrument_id long, symbol string, valid_from date, valid_to date, source string, "
    "ingested_at timestamp",
    "candle": f"instrument_id long, interval string, ts timestamp, available_at timestamp, {_PRICE}, "
    "volume decimal(24,4), source string, ingested_at timestamp",
    "minute_bar": f"instrument_id long, session_date date, ts timestamp, available_at timestamp, {_PRICE}, "
    "volume decimal(24,4), source string, ingested_at timestamp",
    "live_second_bar": f"instrument_id long, session_date date, ts timestamp, {_PRICE}, volume decimal(24,4), "
    "ingested_at timestamp",
    "fx_rate": "base string, quote string, rate_date date, rate decimal(20,8), source string, "
    "available_at timestamp, ingested_at timestamp",
    "fundamental": "instrument_id long, taxonomy string, concept string, unit string, period_start date, "
    "period_end date, fiscal_year int, fiscal_period string, form string, value decimal(30,6), filed_at date, "
    "available_at timestamp, ingested_at timestamp, accession string, source string, semantic_version int",
    "filing": "instrument_id long, form string, filed_at date, period_of_report date, available_at timestamp, "
    "accession string, source string, ingested_at timestamp",
    "disclosure": "instrument_id long, rcept_no string, report_nm string, filer string, filed_on date, "
    "available_at timestamp, ingested_at timestamp",
    "news_item": "source string, url_hash string, url string, publisher_host string, title string, summary string, "
    "published_at timestamp, available_at timestamp, ingested_at timestamp",
    "news_relevance_decision": "query_hit_id long, decision string, decision_reason string, match_method string, "
    "matched_query string, snippet string, rule_version int, decided_by string, model string, prompt_version int, "
    "decided_at timestamp",
    "news_sweep_coverage": "instrument_id long, source string, collector string, covered_from timestamp, "
    "covered_to timestamp, capped boolean, recorded_at timestamp",
    "signal": "instrument_id long, data_asof timestamp, decision_at timestamp, earliest_execution_at timestamp, "
    "total_score double, action string, policy string, abstained_reason string, strategy_version string, "
    "factors array<struct<engine:string,score:double,requested_weight:double,effective_weight:double,"
    "contribution:double,availability:string,metrics:array<struct<name:string,raw:double,normalized:double>>>>, "
    "ingested_at timestamp",
    "watchlist_member": "session_date date, selection_version int, instrument_id long, rank int, "
    "reasons array<string>, excluded array<string>, overlay_points double, discovery_score double, "
    "attention_surge double, total_score double",
    "backtest_run": "run_id string, instrument_id long, strategy_kind string, strategy_fingerprint string, "
    "data_snapshot_at timestamp, period_start date, period_end date, starting_cash decimal(24,8)",
    "backtest_window": "run_id string, window_index int, sample_type string, period_start date, period_end date, "
    "total_return double, cagr double, max_drawdown double, sharpe double, win_rate double, profit_factor double, "
    "trades int",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])  # type: ignore[return-value]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
