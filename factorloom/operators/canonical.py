"""Raw feed rows to canonical rows: typed projections, aliases, identifiers and quarantine. Each job is one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts as X

# The names that feeds give to one field, in order of preference.
JP_ALIASES = {
    "code": ["stock_code", "code", "sec_code", "securityCode"],
    "market": ["exchange", "market", "venue"],
    "raw_id": ["security_id", "securityId"],
    "filing": ["filing_date", "filingDate", "submitDate"],
    "period": ["period_end", "periodEnd", "fiscalPeriodEnd"],
    "rd": ["rd_expense", "rnd_expense", "ResearchAndDevelopmentExpenses"],
    "sales": ["sales_ttm", "revenue_ttm", "NetSales", "sales"],
    "as_of": ["as_of_date", "asOfDate"],
    "to": ["effective_to", "effectiveTo"],
    "current": ["is_current", "isCurrent"],
}
VALIDITY = ["effective_from", "effective_to", "is_current"]
# The columns of each entity.
ENTITIES = {
    "constituent": ["as_of_date", "security_id", "issuer_id", "ticker", "stock_code", "exchange", "country", "universe"],
    "fundamental": ["as_of_date", "security_id", "country", "period_end", "filing_date", "rd_expense", "sales_ttm"],
    "price": ["as_of_date", "security_id", "country", "price_date", "close", "currency"],
    "benchmark": ["as_of_date", "benchmark_id", "country", "benchmark_date", "close", "currency"],
    "fx": ["as_of_date", "pair", "fx_date", "rate"],
}


def required_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """df; raises where it is planned if columns are missing, and names them."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError("missing fields: " + ", ".join(missing))
    return df


def missing_values(names: list[str]) -> Column:
    """The names of the fields that are null or blank in a row."""
    return F.array_compact(F.array(*[F.when(X.blank_to_null(F.col(n).cast("string")).isNull(), n) for n in names]))


def _typed(name: str) -> Column:
    text = F.col(name).cast("string")
    if name.endswith("_date") or name.startswith("effective_") or name == "period_end":
        return X.any_date(text)
    if name in ("rd_expense", "sales_ttm", "close", "rate"):
        return X.finite(text)
    if name == "is_current":
        return X.boolean(text)
    if name in ("country", "universe"):
        return F.lower(F.trim(text))
    if name in ("pair", "currency"):
        return F.upper(F.trim(text))
    return F.trim(text)


def canonical(df: DataFrame, entity: str) -> DataFrame:
    """The entity's columns, typed, with ``errors``: fields that are missing or don't parse, and windows that contradict themselves."""
    names = ENTITIES[entity] + VALIDITY
    required_fields(df, names)
    optional = {"effective_to"}
    t = df.select(*[_typed(n).alias(n) for n in names], *[X.blank_to_null(F.col(n).cast("string")).isNotNull().alias(f"_has_{n}") for n in names])
    bad = [F.when(F.col(n).isNull() & (F.lit(n not in optional) | F.col(f"_has_{n}")), n) for n in names]
    end, start = F.col("effective_to"), F.col("effective_from")
    window = F.when((end < start) | (F.col("is_current") != end.isNull()), "window")
    return t.withColumn("errors", F.array_compact(F.array(*bad, window))).drop(*[f"_has_{n}" for n in names])


def split_errors(df: DataFrame, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, failures with their ordinal and messages)."""
    good = df.where(F.size("errors") == 0).drop("errors")
    return good, df.where(F.size("errors") > 0).select(ordinal, F.array_join("errors", "|").alias("message"))


def transform_jp(rows: DataFrame, default_exchange: str = "TSE", letters: bool = True) -> DataFrame:
    """Filing rows under any of their aliases to fundamentals with ``errors``; ``ordinal`` is the row's place in its source."""
    pick = lambda field: X.first_present(JP_ALIASES[field], rows.columns)
    raw = rows.select("ordinal", *[pick(f).alias(f"_{f}") for f in JP_ALIASES])
    code, venue = X.stock_code(F.col("_code"), letters), X.exchange(F.col("_market"), default_exchange)
    t = raw.select(
        "ordinal",
        X.security_id_jp(F.col("_raw_id"), code, venue, letters).alias("security_id"),
        X.any_date(F.col("_period")).alias("period_end"),
        X.any_date(F.col("_filing")).alias("filing_date"),
        X.accounting(F.col("_rd")).alias("rd_expense"),
        X.accounting(F.col("_sales")).alias("sales_ttm"),
        F.coalesce(X.any_date(F.col("_as_of")), X.any_date(F.col("_filing"))).alias("as_of_date"),
        X.any_date(F.col("_to")).alias("effective_to"),
        F.coalesce(X.boolean(F.col("_current")), F.col("_to").isNull()).alias("is_current"),
        (F.col("_rd").isNotNull() & X.accounting(F.col("_rd")).isNull()).alias("_bad_rd"),
        (F.col("_sales").isNotNull() & X.accounting(F.col("_sales")).isNull()).alias("_bad_sales"),
    )
    errors = [F.when(F.col(c).isNull(), c) for c in ("security_id", "period_end", "filing_date")] + [F.when(F.col("_bad_rd"), "rd_expense"), F.when(F.col("_bad_sales"), "sales_ttm")]
    return t.withColumn("errors", F.array_compact(F.array(*errors))).drop("_bad_rd", "_bad_sales").withColumn("country", F.lit("jp"))


def corp_code_map(rows: DataFrame) -> DataFrame:
    """(corp_code, stock_code): the last mapping that isn't blank."""
    code = X.stock_code(F.col("stock_code").cast("string"))
    ok = rows.select(F.trim("corp_code").alias("corp_code"), code.alias("stock_code"), "ordinal").where("corp_code <> '' and stock_code is not null")
    return ok.groupBy("corp_code").agg(F.max_by("stock_code", "ordinal").alias("stock_code"))


def transform_kr(rows: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fundamentals, corp codes that have no stock code). A row's own stock code goes before the map's; 0 is a value."""
    own = X.stock_code(F.col("stock_code").cast("string"))
    joined = rows.withColumn("_own", own).join(mapping.select("corp_code", F.col("stock_code").alias("_mapped")), "corp_code", "left")
    joined = joined.withColumn("_code", F.coalesce("_own", "_mapped"))
    number = lambda names: X.accounting(X.first_present(names, rows.columns))
    filed = X.any_date(F.col("filing_date").cast("string"))
    good = joined.where("_code is not null").select(
        F.concat(F.lit("KRX:"), "_code").alias("security_id"), F.lit("kr").alias("country"), X.any_date(F.col("period_end").cast("string")).alias("period_end"), filed.alias("filing_date"),
        number(["rd_expense", "rnd_expense"]).alias("rd_expense"), number(["sales_ttm", "revenue_ttm", "sales"]).alias("sales_ttm"), filed.alias("as_of_date"), filed.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("is_current"),
    )
    return good, joined.where("_code is null").groupBy("corp_code").agg(F.count("*").alias("n"))


def transform_us(points: DataFrame) -> DataFrame:
    """Matched R&D and sales points to fundamentals; what was filed is known from its filing date on."""
    return points.select("security_id", F.lit("us").alias("country"), "period_end", "filing_date", "rd_expense", "sales_ttm", F.col("filing_date").alias("as_of_date"), F.col("filing_date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("is_current"))


def missing_payloads(universe: DataFrame, payloads: DataFrame, key: str = "security_id") -> DataFrame:
    """(key, message) of those without a payload, or with an empty one."""
    got = universe.select(key).distinct().join(payloads.select(key, "payload"), key, "left")
    said = F.when(F.col("payload").isNull(), "missing payload").when(F.trim("payload").isin("", "{}", "[]"), "empty payload")
    return got.select(key, said.alias("message")).where("message is not null")


def normalize_fx(rows: DataFrame) -> DataFrame:
    """Pairs in capitals, dates from fx_date or as_of_date, rates as numbers; a row is current where no end is given."""
    day = X.any_date(X.first_present(["fx_date", "as_of_date"], rows.columns))
    end = X.any_date(F.col("effective_to").cast("string")) if "effective_to" in rows.columns else F.lit(None).cast("date")
    t = rows.select(F.upper(F.trim("pair")).alias("pair"), day.alias("fx_date"), X.finite(F.col("rate").cast("string")).alias("rate"), end.alias("effective_to"))
    return t.withColumn("is_current", F.col("effective_to").isNull())


def with_provenance(rows: DataFrame, source: Column, flag: Column) -> DataFrame:
    return rows.withColumns({"source": F.lower(F.trim(source)), "quality_flag": F.lower(F.trim(flag))})


def filter_documents(docs: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, filers: list[str] | None = None, require_code: bool = True) -> DataFrame:
    """Documents whose metadata are complete and whose type and filer are wanted."""
    keep = F.size(missing_values(["docID", "docType", "filer"])) == 0
    if include is not None:
        keep = keep & F.col("docType").isin(include)
    if exclude:
        keep = keep & ~F.col("docType").isin(exclude)
    if filers is not None:
        keep = keep & F.col("filer").isin(filers)
    if require_code:
        keep = keep & X.blank_to_null(F.col("secCode")).isNotNull()
    return docs.where(keep)


def index_symbols(spark: SparkSession, path: str, column: str, dots: bool = True) -> DataFrame:
    """The distinct symbols of an index snapshot in CSV files: trimmed, in capitals, with dots for dashes; blank ones go."""
    rows = spark.read.option("header", True).csv(path)
    symbol = F.upper(F.trim(F.col(column)))
    return rows.select((F.translate(symbol, "-", ".") if dots else symbol).alias("symbol")).where("symbol <> ''").distinct()


def prices_of(prices: DataFrame, wanted: DataFrame, key: str = "security_id") -> DataFrame:
    """The prices of wanted securities only; where none is wanted, all prices stay."""
    if wanted.isEmpty():
        return prices
    return prices.join(wanted.select(key).distinct(), key, "left_semi")


def market_scope(specs: DataFrame, countries: list[str]) -> DataFrame:
    """specs of the countries in scope; raises if one of them has none."""
    kept = specs.where(F.upper("country").isin(countries))
    got = {r["c"] for r in kept.select(F.upper("country").alias("c")).distinct().collect()}  # one row for each country
    if missing := sorted(set(countries) - got):
        raise ValueError("no securities of " + ", ".join(missing))
    return kept


def core_universe(specs: DataFrame, symbols: DataFrame, universe: str) -> DataFrame:
    """specs whose ticker is among symbols, under the index's name."""
    wanted = symbols.select(F.upper(F.translate(F.trim("symbol"), "-", ".")).alias("_t")).distinct()
    return specs.join(wanted, F.upper(F.translate(F.trim("ticker"), "-", ".")) == F.col("_t"), "left_semi").withColumn("universe", F.lit(universe))
