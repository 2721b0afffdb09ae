"""The partitioned price store, its migration from the older layout, and output manifests."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import finite

_LOCAL: str | None = None


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for name where all executors can write; where spark.checkpoint.dir is unset, a temporary one in local mode only."""
    global _LOCAL
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _LOCAL is None or not os.path.isdir(_LOCAL):
            _LOCAL = tempfile.mkdtemp(prefix="spark-factorloom-")
        base = f"file://{_LOCAL}"
    return f"{base.rstrip('/')}/factorloom-{uuid.uuid4().hex}/{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what several branches of a plan read is computed once, and lost executors don't lose it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ticker_norm(c: F.Column) -> F.Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def write_price_partitions(prices: DataFrame, path: str, mode: str = "append", buckets: int = 64, overwrite: bool = False) -> DataFrame:
    """Writes prices (ticker, price_date, close, volume) by ticker bucket and year, replacing only the partitions it has rows for; returns rows whose given year contradicts the date, which are not written.

    Tickers by the hundred thousand would make as many folders, so a folder holds a hash bucket of them, sorted."""
    year = F.year("price_date")
    given = F.col("year") if "year" in prices.columns else year
    rows = prices.withColumns({"ticker_norm": ticker_norm(F.col("ticker")), "_year": year, "year": given})
    good = rows.where("year = _year").drop("_year").withColumn("bucket", F.pmod(F.xxhash64("ticker_norm"), F.lit(buckets)).cast("int"))
    sorted_ = good.repartition("bucket", "year").sortWithinPartitions("bucket", "year", "ticker_norm", "price_date")
    writer = sorted_.write.partitionBy("bucket", "year").mode("overwrite" if overwrite or mode == "replace" else mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return rows.where("year <> _year or year is null").drop("_year")


def read_price_partitions(spark: SparkSession, path: str, first_year: int, last_year: int) -> DataFrame:
    """Rows of the tickers that have every year of the window: no close missing, volume 0 at least. A partition with a row of another year is left out whole."""
    rows = spark.read.parquet(path).where(F.col("year").between(first_year, last_year))
    parts = rows.groupBy("ticker_norm", "year").agg(F.bool_and(F.year("price_date") == F.col("year")).alias("ok"), F.count("close").alias("n"))
    full = parts.where("ok and n > 0").groupBy("ticker_norm").agg(F.count_distinct("year").alias("years")).where(F.col("years") == last_year - first_year + 1)
    kept = rows.where("close is not null").join(full.select("ticker_norm"), "ticker_norm", "left_semi")
    return kept.select("ticker", "ticker_norm", "year", "price_date", "close", F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)).alias("volume"))


#: What the header of a price partition says.
HEADER_VERSION, PROVIDER = "v2", "yfinance"
_HEADER = "version string, provider string, ticker string, ticker_norm string, year string, start string, end string"


def partition_headers(prices: DataFrame, start: str, end: str) -> DataFrame:
    """A header for each ticker and year of prices (ticker, price_date): version, provider, ticker, its name in the store, year, and the window that was asked for."""
    each = prices.select("ticker", ticker_norm(F.col("ticker")).alias("ticker_norm"), F.year("price_date").alias("year")).distinct()
    return each.select(F.lit(HEADER_VERSION).alias("version"), F.lit(PROVIDER).alias("provider"), "ticker", "ticker_norm", F.col("year").cast("string").alias("year"), F.lit(start).alias("start"), F.lit(end).alias("end"))


def write_headers(headers: DataFrame, path: str, buckets: int = 64) -> None:
    """Headers as JSON lines beside the store's partitions, by the bucket and year of the partition that each belongs to (part_norm and part_year where given)."""
    norm = F.col("part_norm") if "part_norm" in headers.columns else F.col("ticker_norm")
    year = F.col("part_year") if "part_year" in headers.columns else F.col("year")
    lines = headers.select(F.to_json(F.struct(*[F.col(c.split()[0]) for c in _HEADER.split(", ")])).alias("header"), norm.alias("part_norm"), year.cast("int").alias("part_year"))
    lines.withColumn("bucket", F.pmod(F.xxhash64("part_norm"), F.lit(buckets)).cast("int")).repartition("bucket", "part_year").write.mode("append").partitionBy("bucket", "part_year").parquet(path)


def checked_partitions(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(ticker_norm, year, error) of every partition of rows (ticker, ticker_norm, year, price_date, close): error says what its header lacks, and is null if nothing.

    Rows are summed up by partition before they meet the headers, on partition and year, so no row is sent for the check. headers: what write_headers has written."""
    h = headers.select("part_norm", "part_year", F.from_json("header", _HEADER).alias("h"))
    one = h.groupBy("part_norm", "part_year").agg(F.count("*").alias("_n"), F.min("h").alias("h"))
    parts = rows.groupBy("ticker_norm", "year").agg(F.min("ticker").alias("ticker"), F.count_distinct("ticker").alias("_tickers"), F.bool_and(F.year("price_date") == F.col("year")).alias("_own_year"), F.count("close").alias("_closes"))
    j = parts.join(one, (F.col("ticker_norm") == F.col("part_norm")) & (F.col("year") == F.col("part_year")), "left")
    differs = lambda c, want: ~F.coalesce(F.trim(F.col(c)) == want, F.lit(False))
    error = (
        F.when(F.col("_n").isNull(), "no header").when(F.col("_n") > 1, "several headers")
        .when(differs("h.version", F.lit(HEADER_VERSION)), "version").when(differs("h.provider", F.lit(PROVIDER)), "provider")
        .when((F.col("_tickers") > 1) | differs("h.ticker", F.col("ticker")), "ticker").when(differs("h.ticker_norm", F.col("ticker_norm")), "ticker name")
        .when(~F.col("h.year").eqNullSafe(F.col("year").cast("string")), "year")
        .when(F.try_to_date(F.trim("h.start"), "yyyy-MM-dd").isNull() | F.try_to_date(F.trim("h.end"), "yyyy-MM-dd").isNull(), "window")
        .when(~F.col("_own_year"), "row of another year").when(F.col("_closes") == 0, "no close")
    )
    return j.select("ticker_norm", "year", error.alias("error"))


def read_checked(spark: SparkSession, path: str, header_path: str, first_year: int, last_year: int) -> DataFrame:
    """Rows of the window's years whose partition's header is in order; the others are left out partition by partition."""
    rows = spark.read.parquet(path).where(F.col("year").between(first_year, last_year))
    fine = checked_partitions(rows, spark.read.parquet(header_path).where(F.col("part_year").between(first_year, last_year))).where("error is null")
    return rows.where("close is not null").join(fine.select("ticker_norm", "year"), ["ticker_norm", "year"], "left_semi")


def stitch(series: DataFrame, start: str, end: str) -> DataFrame:
    """The series of all years between two dates; years outside are not read."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    return series.where(F.col("year").between(F.year(a), F.year(b)) & F.col("price_date").between(a, b))


def fresh(files: DataFrame, now: str, ttl_days: int) -> DataFrame:
    """files that were written within ttl_days before now; 0 never expires. files has ``modified``."""
    return files if ttl_days == 0 else files.where(F.col("modified") >= F.lit(now).cast("timestamp") - F.expr(f"interval {ttl_days} days"))


def write_price_windows(prices: DataFrame, path: str) -> None:
    """The older layout: a JSON object for each ticker with its window's start and end and its rows."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("price_date").cast("string").alias("date"), F.col("close").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"))))
    prices.groupBy("ticker").agg(F.min("price_date").alias("start"), F.max("price_date").alias("end"), rows.alias("rows")).write.json(path)


def read_price_windows(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, price_date, close, volume) of the older layout. Rows without a date or a number as close go, volumes are 0 at least; of a date's rows the last counts."""
    files = spark.read.schema("ticker string, start string, end string, rows array<struct<date: string, close: string, volume: string>>").json(path)
    each = files.select("ticker", F.posexplode("rows").alias("pos", "r"))
    volume = F.greatest(F.coalesce(finite(F.col("r.volume")), F.lit(0.0)), F.lit(0.0))
    typed = each.select("ticker", F.try_to_date(F.trim("r.date"), "yyyy-MM-dd").alias("price_date"), finite(F.col("r.close")).alias("close"), volume.alias("volume"), "pos").where("price_date is not null and close is not null")
    return typed.groupBy("ticker", "price_date").agg(F.max(F.struct("pos", "close", "volume")).alias("x")).select("ticker", "price_date", "x.close", "x.volume")


def serve(spark: SparkSession, path: str, v1: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(ticker, price_date, close, volume, origin) of a window of years: of the new layout for tickers that are complete there, else of the old one."""
    columns = ["ticker", "price_date", "close", "volume"]
    old = v1.where(F.year("price_date").between(first_year, last_year))
    return migrate(read_price_partitions(spark, path, first_year, last_year).select(*columns), old.select(*columns))


def repair(spark: SparkSession, path: str, rows: DataFrame, buckets: int = 64) -> None:
    """Writes rows (ticker, price_date, close, volume) into the new layout: days they have replace those of the store, the rest of the partitions they touch stays."""
    place = {"ticker_norm": ticker_norm(F.col("ticker")), "year": F.year("price_date")}
    new = saved(rows.withColumns(place).withColumn("bucket", F.pmod(F.xxhash64("ticker_norm"), F.lit(buckets)).cast("int")), "repaired")
    kept = spark.read.parquet(path).join(new.select("bucket", "year").distinct(), ["bucket", "year"], "left_semi").join(new.select("ticker_norm", "price_date"), ["ticker_norm", "price_date"], "left_anti")
    columns = ["ticker", "price_date", "close", "volume"]
    write_price_partitions(saved(kept.select(*columns).unionByName(new.select(*columns)), "merged"), path, buckets=buckets, overwrite=True)


def migration_counters(spark: SparkSession, path: str, v1: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Serves a window, repairs the new layout from the old one, and says for how many tickers (event, n): v2_hit, v1_fallback, repair_success, repair_failure."""
    served = saved(serve(spark, path, v1, first_year, last_year), "served")
    fallback = served.where("origin = 'v1'")
    repair(spark, path, fallback.select("ticker", "price_date", "close", "volume"))
    now = read_price_partitions(spark, path, first_year, last_year).select("ticker").distinct().withColumn("_ok", F.lit(True))
    tickers = served.select("ticker", "origin").distinct().join(now, "ticker", "left")
    count = lambda c: F.count_if(c)
    one = tickers.agg(count(F.col("origin") == "v2").alias("v2_hit"), count(F.col("origin") == "v1").alias("v1_fallback"), count((F.col("origin") == "v1") & F.col("_ok").isNotNull()).alias("repair_success"), count((F.col("origin") == "v1") & F.col("_ok").isNull()).alias("repair_failure"))
    return one.unpivot([], one.columns, "event", "n")


def write_filing_index(listings: DataFrame, path: str) -> None:
    """Listings (day, ...) as JSON lines by month; a folder a day would hold a handful of rows."""
    lines = listings.select(F.date_format("day", "yyyy-MM").alias("month"), F.to_json(F.struct(*[F.col(c) for c in listings.columns])).alias("value"))
    lines.repartition("month").write.mode("append").partitionBy("month").text(path)


def read_filing_window(spark: SparkSession, path: str, start: str, end: str, fields: str) -> DataFrame:
    """The listings of all days from start to end; only their months are read. Lines that are no listing are left out, not an error. fields: the columns' types as DDL, with day."""
    rows = spark.read.schema(f"{fields}, _malformed string, month string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").json(path)
    inside = F.col("month").between(F.date_format(F.lit(start).cast("date"), "yyyy-MM"), F.date_format(F.lit(end).cast("date"), "yyyy-MM"))
    days = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return rows.where(inside & days & F.col("_malformed").isNull()).drop("_malformed", "month")


def migrate(v2: DataFrame, v1: DataFrame) -> DataFrame:
    """Rows of the new layout, and of the old one for tickers that the new one lacks; origin says which."""
    missing = v1.join(v2.select("ticker").distinct(), "ticker", "left_anti")
    return v2.withColumn("origin", F.lit("v2")).unionByName(missing.withColumn("origin", F.lit("v1")))


def unpivot_wide(wide: DataFrame, tickers: list[str]) -> DataFrame:
    """One row a day with columns close_<ticker> and volume_<ticker> to one row a ticker and day; no row without a finite close."""
    long = wide.unpivot(["price_date"], [f"{m}_{t}" for t in tickers for m in ("close", "volume")], "name", "value")
    parts = long.select("price_date", F.split("name", "_", 2)[0].alias("metric"), F.split("name", "_", 2)[1].alias("ticker"), "value")
    p = parts.groupBy("ticker", "price_date").pivot("metric", ["close", "volume"]).agg(F.first("value"))
    return p.where("close is not null and not isnan(close) and abs(close) < double('Infinity')").withColumn("volume", F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)))


def read_fact_files(spark: SparkSession, path: str, encoding: str = "UTF-16LE") -> DataFrame:
    """Tab-separated fact files; rows with under nine columns are left out, quotes, control characters and byte-order marks go. The encoding names the order of bytes, as lines are looked for in them."""
    names = ["element", "label", "context", "relative_year", "consolidated", "period", "unit", "unit_scale", "value"]
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
    parts = lines.select(F.split("value", "\t").alias("p")).where(F.size("p") >= 9)
    clean = lambda c: F.trim(F.regexp_replace(c, "[\\x00-\\x1F\\uFEFF\"]", ""))
    return parts.select(*[clean(F.col("p")[i]).alias(n) for i, n in enumerate(names)]).where(F.col("value").isNotNull())


def manifest(outputs: dict[str, DataFrame]) -> DataFrame:
    """(output, rows, digest) of each named output; the digest doesn't depend on the rows' order."""
    from ..operators.report import content_digest

    parts = [content_digest(df).withColumn("output", F.lit(name)) for name, df in outputs.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("output", "rows", "digest")


def run_id(start: str, end: str) -> str:
    """A run's name, from its window of dates."""
    return f"run_{start.replace('-', '')}_{end.replace('-', '')}"


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below path. A file's bytes are one row: for outputs of files of some MB, as reports are."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_report(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below path; dates as ISO, null fields kept, and no NaN or infinite number."""
    from ..operators.report import non_finite_counts

    for name, df in tables.items():
        bad = non_finite_counts(df).where("n > 0").collect() if any(t in ("double", "float") for _, t in df.dtypes) else []
        if bad:
            raise ValueError(f"{name}: not finite: " + ", ".join(r["column_name"] for r in bad))
        df.write.option("ignoreNullFields", "false").json(f"{path}/{name}")


def write_document(config: dict, metrics: DataFrame, tables: dict[str, DataFrame], path: str, max_rows: int = 10_000) -> None:
    """One JSON document of a run: its config, its metrics (one row, of any nesting) and its tables as arrays of objects in order of all their columns.

    For reports, which are small: a table of more than max_rows rows is an error, as are metrics that aren't one row and
    any value that isn't finite, however deep. Dates are ISO, null fields are kept."""
    from ..operators.report import nested_non_finite

    spark = metrics.sparkSession
    for name, df in {"metrics": metrics, **tables}.items():
        if bad := nested_non_finite(df).where("n > 0").collect():
            raise ValueError(f"{name}: not finite: " + ", ".join(sorted(r["path"] for r in bad)))
    if metrics.limit(2).count() != 1:
        raise ValueError("metrics must be one row")
    one = metrics.select(F.struct(*[F.col(f"`{c}`") for c in metrics.columns]).alias("metrics"))
    for name, df in tables.items():
        if df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"{name}: more than {max_rows} rows are no report")
        one = one.crossJoin(df.agg(F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias(name)))  # one row by one row
    body = F.struct(*[F.col(f"`{name}`") for name in tables])
    said = spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string")
    text = F.to_json(F.struct("metrics", body.alias("tables")), {"ignoreNullFields": "false"})
    one.select(text.alias("rest")).crossJoin(said).select(F.concat(F.lit('{"config":'), "config", F.lit(","), F.substring("rest", 2, 2**31 - 1)).alias("value")).coalesce(1).write.text(path)
