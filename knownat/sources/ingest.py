"""From raw provider rows to stored rows: parsing, validation, and append rules."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from knownat.functions.scale import newest
from knownat.operators.pit import finite


# ------------------------------------------------------------------ append rules

def changed_revisions(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows that differ from the newest stored revision of their key in any value (null equals null)."""
    last = newest(stored, list(keys), list(order)).select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_had"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return incoming.join(last, list(keys), "left").where(F.col("_had").isNull() | ~same).select(*incoming.columns)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Insert-ignore by natural key: the first incoming row per key that is not stored yet."""
    first = newest(incoming, list(keys), list(order), first=True)
    return first.join(stored.select(*keys).distinct(), list(keys), "left_anti").select(*incoming.columns)


def upserted(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after an upsert in which the later row wins."""
    return newest(stored.unionByName(incoming), list(keys), list(order))


def counted(calls: DataFrame) -> DataFrame:
    """Call counters per (group, endpoint, minute): appended rows are added up."""
    return calls.groupBy("quota_group", "endpoint", F.date_trunc("minute", "at").alias("minute_start")).agg(F.sum("calls").alias("calls"))


def known_only(rows: DataFrame, master: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Rows whose instrument still exists."""
    return rows.join(master.select(key).distinct(), key, "left_semi")


# ------------------------------------------------------------------ bars and rates

def daily_bars(raw: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Finite bars of closed sessions, stamped with the session's open and close; a missing volume is 0."""
    stamped = raw.where(finite("open", "high", "low", "close")).join(
        sessions.select("day", F.col("open_at").alias("ts"), F.col("close_at").alias("available_at")), "day").where(F.col("available_at") <= now)
    volume = F.when(F.isnan(F.col("volume").cast("double")) | F.col("volume").isNull(), F.lit(0.0)).otherwise(F.col("volume"))
    return stamped.select("instrument_id", "ts", "available_at", *[F.round(c, 6).cast("decimal(20,6)").alias(c) for c in ("open", "high", "low", "close")], F.round(volume, 4).cast("decimal(24,4)").alias("volume"))


def fx_rates(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """New daily rates, known from 00:00 UTC of the next day."""
    rows = raw.where(finite("rate")).withColumn("available_at", F.date_add("rate_date", 1).cast("timestamp"))
    return rows.join(stored.select("base", "quote", "rate_date"), ["base", "quote", "rate_date"], "left_anti")


OPEN_LABEL, CLOSE_LABEL = "090000", "153000"


def minute_rows(raw: DataFrame, *, zone: str = "Asia/Seoul") -> DataFrame:
    """Labelled local minutes to UTC bars, known one minute after their start; bad or off-hours rows drop out."""
    label = F.col("label")
    ok = label.rlike(r"^\d{6}$") & label.between(OPEN_LABEL, CLOSE_LABEL) & finite("open", "high", "low", "close", "volume")
    for c in ("open", "high", "low", "volume"):
        ok = ok & (F.col(c) >= 0)
    local = F.to_timestamp(F.concat(F.date_format("day", "yyyyMMdd"), F.substring(label, 1, 4)), "yyyyMMddHHmm")
    start = F.to_utc_timestamp(local, zone)
    return raw.where(ok & (F.col("close") > 0)).withColumns({"ts": start, "available_at": F.timestamp_add("MINUTE", F.lit(1), start)})


def day_status(rows: DataFrame, keys: Sequence[str] = ("instrument_id", "day")) -> DataFrame:
    """Completeness of a fetched day from its pages.

    ``rows``: page, own_day (the row belongs to the asked day), earlier (an earlier day appeared), label.  The day
    before appearing, or a label at the open, proves the day was read to its start; otherwise it is partial.
    """
    own = F.col("own_day")
    pages = rows.groupBy(*keys).agg(
        F.bool_or(F.coalesce("earlier", F.lit(False))).alias("_earlier"), F.min(F.when(own, F.col("label"))).alias("_oldest"),
        F.count(F.when(own & F.col("label").between(OPEN_LABEL, CLOSE_LABEL), 1)).alias("bars"), F.max("page").alias("pages"))
    done = F.col("_earlier") | (F.col("_oldest") <= OPEN_LABEL)
    return pages.select(*keys, "bars", "pages", F.when(~F.coalesce(done, F.lit(False)), "PARTIAL").when(F.col("bars") > 0, "COMPLETE").otherwise("EMPTY").alias("status"))


def provider_ticker(symbol: Column | str, market: Column | str, listing: Column | str) -> Column:
    s, m, b = (F.col(x) if isinstance(x, str) else x for x in (symbol, market, listing))
    return F.concat(s, F.when(b == "KOSDAQ", ".KQ").when((b == "KOSPI") | (m == "KR"), ".KS").otherwise(""))


# ------------------------------------------------------------------ filings and facts

# Concepts and forms kept from company facts, and the account names mapped onto concepts.
WANTED_CONCEPTS = (
    "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "NetIncomeLoss", "EarningsPerShareBasic", "EarningsPerShareDiluted",
    "Assets", "Liabilities", "StockholdersEquity", "OperatingIncomeLoss", "CashAndCashEquivalentsAtCarryingValue",
)
WANTED_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "20-F/A", "40-F", "40-F/A")
ACCOUNT_PREFIXES = ("ifrs-full_", "ifrs_")
ACCOUNTS = {
    "Revenue": "Revenues", "ProfitLossAttributableToOwnersOfParent": "NetIncomeLoss", "BasicEarningsLossPerShare": "EarningsPerShareBasic",
    "DilutedEarningsLossPerShare": "EarningsPerShareDiluted", "Assets": "Assets", "Liabilities": "Liabilities",
    "EquityAttributableToOwnersOfParent": "StockholdersEquity", "CashAndCashEquivalents": "CashAndCashEquivalentsAtCarryingValue",
}
LOCAL_ACCOUNTS = {"dart_OperatingIncomeLoss": "OperatingIncomeLoss"}
SEPARATE_ACCOUNTS = {"ProfitLoss": ("NetIncomeLoss", ("IS", "CIS")), "Equity": ("StockholdersEquity", ("BS",))}
INSTANTANEOUS = ("Assets", "Liabilities", "StockholdersEquity", "CashAndCashEquivalentsAtCarryingValue")
PERIOD_COLUMNS = ("thstrm_amount", "frmtrm_amount", "bfefrmtrm_amount")

FACTS_SCHEMA = (
    "struct<facts: map<string, map<string, struct<units: map<string, array<struct<"
    "start: string, `end`: string, val: string, form: string, filed: string, accn: string>>>>>>>"
)


def company_facts(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """Nested company facts to one row per filed revision of a wanted concept and form (amendments included)."""
    parsed = payloads.withColumn("_p", F.from_json(body, FACTS_SCHEMA))
    keep = [c for c in payloads.columns if c != body]
    taxa = parsed.select(*keep, F.explode("_p.facts").alias("taxonomy", "_concepts"))
    concepts = taxa.select(*keep, "taxonomy", F.explode("_concepts").alias("concept", "_units")).where(F.col("concept").isin(*WANTED_CONCEPTS))
    units = concepts.select(*keep, "taxonomy", "concept", F.explode("_units.units").alias("unit", "_rows"))
    rows = units.select(*keep, "taxonomy", "concept", "unit", F.explode("_rows").alias("_r")).where(F.col("_r.form").isin(*WANTED_FORMS))
    out = rows.select(
        *keep, "taxonomy", "concept", "unit", F.expr("try_cast(_r.start AS date)").alias("period_start"), F.expr("try_cast(_r.`end` AS date)").alias("period_end"),
        F.col("_r.form").alias("form"), F.expr("try_cast(_r.val AS decimal(30,6))").alias("value"), F.expr("try_cast(_r.filed AS date)").alias("filed_at"), F.col("_r.accn").alias("accession"))
    return out.where("period_end IS NOT NULL AND value IS NOT NULL AND filed_at IS NOT NULL")


def zipped_filings(blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parallel arrays to rows; unequal lengths fail the job rather than shift a column."""
    sizes = F.array_distinct(F.array(*[F.size(c) for c in columns]))
    guard = F.when(F.size(sizes) > 1, F.raise_error(F.lit("parallel arrays differ in length")).cast("boolean")).otherwise(F.lit(True))
    keep = [c for c in blocks.columns if c not in columns]
    rows = blocks.where(guard).select(*keep, F.explode(F.arrays_zip(*columns)).alias("_z"))
    return rows.select(*keep, *[F.col(f"_z.{c}").alias(c) for c in columns])


def fiscal_bounds(year: Column | str, end_month: Column | str) -> tuple[Column, Column]:
    """First and last day of the fiscal year that closes in ``end_month`` of ``year``."""
    y, m = (F.col(x) if isinstance(x, str) else x for x in (year, end_month))
    last = F.last_day(F.make_date(y, m, F.lit(1)))
    return F.trunc(F.add_months(last, -11), "month"), last


AMOUNT_CEILING = 1e24


def amount(raw: Column | str) -> Column:
    """Amount text to decimal(30,6): blanks, dashes, absurdly large and vanishingly small figures are null."""
    text = F.trim(F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, ",", ""))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text)
    value = number.try_cast("double")
    sane = (F.abs(value) < AMOUNT_CEILING) & ((value == 0) | (F.abs(value) >= 1e-6))
    return F.when(sane, number.try_cast("decimal(38,10)").try_cast("decimal(30,6)"))


def reported_accounts(items: DataFrame) -> DataFrame:
    """Account rows to facts: three reported years each (consolidated), or only the current one (separate).

    ``items``: instrument_id, business_year, end_month, basis (CFS/OFS), account_id, statement and the three
    amount columns.  Only parent-company totals are read; totals of separate statements stand in for them.
    """
    mapped = {f"{p}{k}": v for k, v in ACCOUNTS.items() for p in ACCOUNT_PREFIXES} | LOCAL_ACCOUNTS
    table = F.create_map(*[x for k, v in mapped.items() for x in (F.lit(k), F.lit(v))])
    account = F.col("account_id")
    concept = F.try_element_at(table, account)
    separate = F.lit(None).cast("string")
    for k, (target, statements) in SEPARATE_ACCOUNTS.items():
        hit = account.isin(*[f"{p}{k}" for p in ACCOUNT_PREFIXES]) & F.col("statement").isin(*statements) & (F.col("basis") == "OFS")
        separate = F.when(hit, target).otherwise(separate)
    rows = items.withColumn("concept", F.coalesce(concept, separate)).where("concept IS NOT NULL")
    years = F.array(*[F.struct(F.lit(back).alias("back"), amount(c).alias("value")) for back, c in enumerate(PERIOD_COLUMNS)])
    current = F.filter(years, lambda y: (F.col("basis") == "CFS") | (y["back"] == 0))
    long = rows.select("instrument_id", "business_year", "end_month", "concept", F.explode(current).alias("_y")).where("_y.value IS NOT NULL")
    start, end = fiscal_bounds(F.col("business_year") - F.col("_y.back"), F.col("end_month"))
    return long.select("instrument_id", "concept", F.when(~F.col("concept").isin(*INSTANTANEOUS), start).alias("period_start"), end.alias("period_end"), F.col("_y.value").alias("value"))


def report_period_end(name: Column | str) -> Column:
    """Last day of the month a report name states as ``(YYYY.MM)``; years 1990 to 2100."""
    n = F.col(name) if isinstance(name, str) else name
    y = F.regexp_extract(n, r"\((\d{4})\.(\d{2})\)", 1).try_cast("int")
    m = F.regexp_extract(n, r"\((\d{4})\.(\d{2})\)", 2).try_cast("int")
    return F.when(y.between(1990, 2100) & m.between(1, 12), F.last_day(F.make_date(y, m, F.lit(1))))


def filed_from_receipt(receipt: Column | str) -> Column:
    """Filing date from a 14-digit receipt number, null when it holds no date."""
    r = F.col(receipt) if isinstance(receipt, str) else receipt
    return F.when(r.rlike(r"^[0-9]{14}$"), F.to_date(F.try_to_timestamp(F.substring(r, 1, 8), F.lit("yyyyMMdd"))))


def disclosure_rows(raw: DataFrame, master: DataFrame, spine: DataFrame) -> DataFrame:
    """Filings of listed companies with a title, dated by receipt, available at the next session's open."""
    dated = raw.withColumn("filed_on", filed_from_receipt("rcept_no")).where(F.col("filed_on").isNotNull() & (F.trim("report_nm") != ""))
    listed = dated.join(master.select("corp_code", "instrument_id"), "corp_code")
    return listed.join(spine.select(F.col("day").alias("filed_on"), F.col("after_open").alias("available_at")), "filed_on").where("available_at IS NOT NULL")


def listing_master(documents: DataFrame, body: str = "xml", *, code_tag: str) -> DataFrame:
    """Listed companies of an XML company list: valid corp code and six-character listing code, which stands under ``code_tag``."""
    parsed = documents.select(F.from_xml(F.col(body), f"corp_code string, corp_name string, `{code_tag}` string, modify_date string").alias("_x")).select("_x.*")
    clean = parsed.select(*[F.trim(F.col(f"`{c}`")).alias("listing_code" if c == code_tag else c) for c in parsed.columns])
    return clean.where(F.col("corp_code").rlike(r"^\d{8}$") & F.col("listing_code").rlike(r"^[0-9A-Z]{6}$") & (F.col("corp_name") != ""))


def boards(filings: DataFrame) -> DataFrame:
    """Board of each company as its newest filing states it."""
    return filings.where("board IS NOT NULL").groupBy("corp_code").agg(F.max_by("board", "receipt").alias("board"))


# ------------------------------------------------------------------ news

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "igshid")


def canonical_url(url: Column | str) -> Column:
    """One spelling per address: lower-case host, no default port, tracking or fragment, sorted query, no trailing slash."""
    u = F.trim(F.col(url) if isinstance(url, str) else url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(F.length(path) > 1, F.when(F.regexp_replace(path, "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))).otherwise(path)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    full = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(F.array_sort(full), "&")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def strip_tags(raw: Column | str) -> Column:
    return F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, "<[^>]+>", "")


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities to characters (the one step Spark has no function for)."""
    return text.map(html.unescape, na_action="ignore")


def clean_text(raw: Column | str) -> Column:
    """Tags out, entities decoded, blanks collapsed."""
    return F.trim(F.regexp_replace(F.replace(unescape(strip_tags(raw)), F.lit("\0"), F.lit("")), r"\s+", " "))


def rfc1123(raw: Column | str) -> Column:
    """``Mon, 02 Jan 2024 03:04:05 +0900`` to an instant; a date without a zone is null."""
    r = F.col(raw) if isinstance(raw, str) else raw
    body = F.regexp_extract(r, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4})", 1)
    return F.try_to_timestamp(F.when(body != "", body), F.lit("d MMM yyyy HH:mm:ss Z"))


def news_rows(items: DataFrame, since: Column | None = None) -> DataFrame:
    """Articles with canonical address, its sha256 key, host, clean title and publication instant.

    Items without a usable date, address or title drop out, as do those from before the watermark.  Addresses,
    hosts and titles of any length are kept whole.
    """
    url = canonical_url(F.when(F.trim(F.coalesce("originallink", F.lit(""))) != "", F.col("originallink")).otherwise(F.col("link")))
    rows = items.withColumns({"url": url, "title": clean_text("title"), "published_at": rfc1123("pub_date")})
    rows = rows.where("url IS NOT NULL AND published_at IS NOT NULL AND title <> ''")
    if since is not None:
        rows = rows.where(F.col("published_at") >= since)
    host = F.regexp_extract("url", r"://([^/?]*)", 1)
    return rows.withColumns({"url_hash": F.sha2("url", 256), "publisher_host": host})


def sweep_coverage(sweeps: DataFrame) -> DataFrame:
    """What each sweep read: from the watermark, or from its oldest result when it was cut; nothing if cut empty.

    ``sweeps``: sweep keys, since, asked_at, cut and one row per result (``available_at`` null when none).
    """
    keys = ["instrument_id", "asked_at", "since", "cut"]
    oldest = sweeps.groupBy(*keys).agg(F.min("available_at").alias("oldest"))
    kept = oldest.where(~F.col("cut") | F.col("oldest").isNotNull())
    return kept.select("instrument_id", F.when(F.col("cut"), F.col("oldest")).otherwise(F.col("since")).alias("covered_from"), F.col("asked_at").alias("covered_to"), F.col("cut").alias("capped"))


def watermarks(runs: DataFrame, now: Column) -> DataFrame:
    """Where each collector reads from: 2 h before its last full success, at most 7 days back; 3 days without one."""
    last = runs.groupBy("collector").agg(F.max(F.when(F.col("status") == "SUCCESS", F.col("finished_at"))).alias("_last"))
    back = F.greatest(F.timestamp_add("HOUR", F.lit(-2), F.col("_last")), F.timestamp_add("DAY", F.lit(-7), now))
    return last.select("collector", F.when(F.col("_last").isNull(), F.timestamp_add("DAY", F.lit(-3), now)).otherwise(back).alias("since"))


# ------------------------------------------------------------------ small provider tables

def trend_points(payloads: DataFrame, body: str = "payload") -> DataFrame:
    """Search-trend payloads to (day, ratio) rows."""
    parsed = F.from_json(body, "results array<struct<data array<struct<period string, ratio double>>>>")
    keep = [c for c in payloads.columns if c != body]
    rows = payloads.select(*keep, F.explode(F.element_at(parsed["results"], 1)["data"]).alias("_d"))
    return rows.select(*keep, F.to_date("_d.period").alias("day"), F.col("_d.ratio").alias("ratio")).where("ratio >= 0")


def trend_map(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored map(day -> ratio); one fetch holds one value per day."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "ratio"))))
    return points.groupBy(*keys).agg(entries.alias("series"))


def cap_rows(raw: DataFrame, *, tolerance: float = 0.05) -> DataFrame:
    """Capitalisation ranking with a flag where price times shares disagrees by more than 5 %."""
    implied = F.col("close") * F.col("shares") / 1e8
    off = (F.col("cap") > 0) & (F.abs(implied - F.col("cap")) / F.col("cap") > tolerance)
    return raw.where(F.coalesce(F.col("code") != "", F.lit(False))).withColumns({"implied": implied, "mismatch": F.coalesce(off, F.lit(False))})


PAGE_ROWS = 100


def opinion_rows(raw: DataFrame) -> DataFrame:
    """Broker reports that have a date, a broker and an opinion."""
    date = F.to_date(F.try_to_timestamp("date_text", F.lit("yyyyMMdd")))
    return raw.withColumn("report_date", date).where(
        F.col("report_date").isNotNull() & (F.coalesce("broker", F.lit("")) != "") & (F.coalesce("opinion", F.lit("")) != ""))


def opinion_status(rows: DataFrame, start: Column, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """TRUNCATED when a full page does not reach back to the asked start."""
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("report_date").alias("oldest"))
    return agg.withColumn("status", F.when((F.col("rows") >= PAGE_ROWS) & (F.col("oldest") > start), "TRUNCATED").otherwise("OK"))


def plain_number(raw: Column | str) -> Column:
    r = F.col(raw) if isinstance(raw, str) else raw
    v = F.regexp_replace(r, ",", "").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def mover_rows(raw: DataFrame) -> DataFrame:
    """Common shares of a movers ranking with their change."""
    code = F.trim("code")
    return raw.withColumns({"code": code, "change_pct": plain_number("change_text"), "price": plain_number("price_text")}).where(
        (F.length(code) == 6) & code.endswith("0") & F.col("change_pct").isNotNull())


def quote_rows(raw: DataFrame, field: str = "output") -> DataFrame:
    """Expected-open quotes from their text fields."""
    o = F.col(field)
    return raw.select(*[c for c in raw.columns if c != field], plain_number(o["antc_cnpr"]).alias("expected_price"), plain_number(o["stck_sdpr"]).alias("base_price"),
                      plain_number(o["antc_cntg_prdy_ctrt"]).alias("reported_pct"), plain_number(o["antc_vol"]).cast("long").alias("volume"))


def post_rows(spark, path: str) -> DataFrame:
    """Post archive (CSV, quoted multi-line text) to (instant, text)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path, schema="id string, created_at string, content string")
    return posts_from_text(rows)


def posts_from_text(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.try_to_timestamp("created_at").alias("at"), "content").where("at IS NOT NULL")
