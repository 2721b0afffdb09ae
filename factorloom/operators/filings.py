"""What filings say: facts by tags, statement rows, key figures and passages of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import casts as X

# Words in account names and tags, without spaces and signs, in lower case.
RD_IDS = ["researchanddevelopment", "researchdevelopment", "randd", "developmentcost", "developmentexpense", "researchcost", "researchexpense"]
RD_NAMES = ["연구개발", "연구개발비", "연구비", "개발비"]
RD_NOT = ["capitalised", "capitalized", "accumulated", "amortisation", "amortization", "impairment", "자본화", "누계", "상각", "손상"]
SALES_IDS, SALES_NAMES, SALES_NOT = ["revenue", "sales"], ["매출", "수익"], ["costofsales", "costsales"]
TAG_YES = ["researchanddevelopment", "researchdevelopment", "ordinarydevelopmentexpense", "developmentexpense", "developmentcost", "randd"]
TAG_NOT = [
    "exceptforresearchanddevelopment", "appropriationofresearchanddevelopmentreserves", "capitalised", "capitalized", "capitalisation", "capitalization", "accumulated",
    "amortisation", "amortization", "impairment", "gross", "remainingamortisationperiod", "remainingamortizationperiod", "preclinical", "approvalfornewdrug", "forbioindustry",
    "tableofitems", "tableofmember", "lineitems", "memberof", "reserve", "textblock",
]
CONTEXT_NOT = ["significantinvestmentsinsubsidiariesaxis", "entitystotalforsubsidiariesmember", "researchanddevelopmentexpenseforbioindustrytable", "memberofresearchanddevelopmentexpense"]
REPORT_FORMS = ["10-Q", "10-K", "20-F", "40-F"]
SCALES = {"千": 1e3, "百万": 1e6, "十億": 1e9}


def label(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def has_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def flatten_facts(payloads: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """payloads: cik and payload, JSON of tag -> unit -> facts. (cik, metric, tag_ord, pos, period_end, filed, form, val); only the tags of some metric are read."""
    known = [F.struct(F.lit(m).alias("metric"), F.lit(t).alias("tag"), F.lit(i).alias("tag_ord")) for m, ts in tags.items() for i, t in enumerate(ts)]
    schema = "map<string, map<string, array<struct<end: string, filed: string, form: string, val: double>>>>"
    parsed = payloads.select("cik", F.from_json("payload", schema).alias("f"), F.explode(F.array(*known)).alias("k"))
    units = parsed.select("cik", "k.metric", "k.tag_ord", F.explode(F.map_values(F.element_at("f", F.col("k.tag")))).alias("facts"))
    facts = units.select("cik", "metric", "tag_ord", F.posexplode("facts").alias("pos", "x"))
    return facts.select("cik", "metric", "tag_ord", "pos", X.any_date(F.col("x.end")).alias("period_end"), X.any_date(F.col("x.filed")).alias("filed"), F.col("x.form").alias("form"), F.col("x.val").alias("val"))


def latest_facts(facts: DataFrame, keep_vintages: bool = False) -> DataFrame:
    """Of each metric and period the fact filed last, of equal ones the later tag and row. keep_vintages: the last of each filing date."""
    ok = facts.where(F.col("form").isin(REPORT_FORMS) | F.coalesce(F.trim("form"), F.lit("")).eqNullSafe("")).where("period_end is not null and filed is not null and val is not null")
    keys = ["cik", "metric", "period_end", *["filed"] * keep_vintages]
    last = ok.groupBy(*keys).agg(F.max(F.struct("filed", "tag_ord", "pos", "val")).alias("x"))
    return last.select("cik", "metric", "period_end", F.col("x.filed").alias("filing_date"), F.col("x.val").alias("value"))


def metric_intersection(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Periods with both metrics: filed when the later one was, and filed from 500 days before start to 365 after end."""
    of = lambda m, name: facts.where(F.col("metric") == m).select("cik", "period_end", F.col("value").alias(name), F.col("filing_date").alias(f"_{name}"))
    both = of("rd", "rd_expense").join(of("sales", "sales_ttm"), ["cik", "period_end"]).withColumn("filing_date", F.greatest("_rd_expense", "_sales_ttm")).drop("_rd_expense", "_sales_ttm")
    return both.where(F.col("filing_date").between(F.date_sub(F.lit(start).cast("date"), 500), F.date_add(F.lit(end).cast("date"), 365)))


def consolidated_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the consolidated statement where a filing has one, else of the separate one."""
    whole = Window.partitionBy(*keys)
    return rows.withColumn("_c", F.max((F.col("fs_div") == "CFS").cast("int")).over(whole)).where("_c = 0 or fs_div = 'CFS'").drop("_c")


def statement_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By filing rd_expense and sales: of the rows whose account is one, the value that is largest without its sign, the first of equal ones. amount counts before amount_to_date."""
    ident, name = label(F.col("account_id")), label(F.col("account_nm"))
    value = F.coalesce(X.accounting(F.col("amount").cast("string")), X.accounting(F.col("amount_to_date").cast("string")))
    is_rd = (has_any(ident, RD_IDS) | has_any(name, RD_NAMES)) & ~has_any(ident, RD_NOT) & ~has_any(name, RD_NOT)
    is_sales = (has_any(ident, SALES_IDS) | has_any(name, SALES_NAMES)) & ~has_any(ident, SALES_NOT)
    r = rows.select(*keys, "pos", value.alias("_v"), is_rd.alias("_rd"), is_sales.alias("_s")).where("_v is not null")
    best = lambda flag, out: F.max(F.when(F.col(flag), F.struct(F.abs("_v").alias("a"), (-F.col("pos")).alias("p"), F.col("_v").alias("v")))).getField("v").alias(out)
    return r.groupBy(*keys).agg(best("_rd", "rd_expense"), best("_s", "sales"))


def tag_scored_rd(facts: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """By filing the R&D fact of the best score, then of the largest value. facts: tag, context, value, pos."""
    tag, context = label(F.col("tag")), label(F.col("context"))
    score = (
        F.when(tag.contains("ordinarydevelopmentexpensesellinggeneraladministrativeexpenses"), 5).otherwise(0)
        + F.when(tag.contains("researchanddevelopmentexpense"), 3).otherwise(0)
        + F.when(context.contains(F.concat(F.lit("cfy"), F.col(year).cast("string"))), 8).otherwise(0)
        + F.when(context.contains("consolidatedmember"), 3).otherwise(0)
        - F.when(context.contains("separatemember"), 1).otherwise(0)
        + F.when(context.contains("dfy") | context.contains("duration"), 1).otherwise(0)
    )
    ok = facts.where((F.col("value") > 0) & has_any(tag, TAG_YES) & ~has_any(tag, TAG_NOT) & ~has_any(context, CONTEXT_NOT) & (F.trim("context") != ""))
    best = F.max(F.struct(score.alias("s"), F.col("value").alias("v"), (-F.col("pos")).alias("p")))
    return ok.groupBy(*keys).agg(best.alias("x")).select(*keys, F.col("x.v").alias("rd_tagged"), F.col("x.s").alias("score"))


def filled(statements: DataFrame, tagged: DataFrame, keys: list[str]) -> DataFrame:
    """R&D of the statement, else of the tags."""
    return statements.join(tagged, keys, "left").withColumn("rd_expense", F.coalesce("rd_expense", "rd_tagged")).drop("rd_tagged", "score")


def filing_dates(rows: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """By filing its dates: from the first receipt number of 14 digits and the first period with 8 digits, else 31 March of the next year and the year's end."""
    receipt = F.when(F.col("receipt").rlike(r"^\d{14}$"), F.try_to_date(F.substring("receipt", 1, 8), "yyyyMMdd"))
    digits = F.regexp_replace(F.coalesce("period", F.lit("")), r"\D", "")
    ended = F.when(F.length(digits) >= 8, F.try_to_date(F.expr("right(regexp_replace(coalesce(period, ''), '\\\\D', ''), 8)"), "yyyyMMdd"))
    g = rows.withColumns({"_f": receipt, "_p": ended}).groupBy(*keys, year).agg(F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("pos"))).alias("_f"), F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("pos"))).alias("_p"))
    return g.select(*keys, F.coalesce("_f", F.make_date(F.col(year) + 1, F.lit(3), F.lit(31))).alias("filing_date"), F.coalesce("_p", F.make_date(F.col(year), F.lit(12), F.lit(31))).alias("period_end"))


def key_metrics(facts: DataFrame, keys: list[str]) -> DataFrame:
    """By filing and element the last current and the last prior value, in units. facts: element, context, period, unit_scale, value, pos."""
    period, context = F.lower(F.coalesce("period", F.lit(""))), F.lower(F.coalesce("context", F.lit("")))
    current = period.contains("current") | (context.contains("current") & ~period.contains("duration")) | ((period == "") & ~context.contains("prior"))
    prior = ~current & (period.contains("prior") | context.contains("prior"))
    scale = F.lit(1.0)
    for mark, by in SCALES.items():
        scale = F.when(F.col("unit_scale").contains(mark), by).otherwise(scale)
    f = facts.withColumns({"_v": F.col("value") * scale, "_c": current, "_q": prior})
    last = lambda flag, out: F.max_by("_v", F.when(F.col(flag), F.col("pos"))).alias(out)
    return f.groupBy(*keys, "element").agg(last("_c", "current"), last("_q", "prior")).where("current is not null or prior is not null")


def text_blocks(facts: DataFrame, keys: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """The last narrative block of each name, if it has over 50 characters."""
    known = F.element_at(F.create_map(*[F.lit(x) for k, e in (names or {"": ""}).items() for x in (e, k)]), F.col("element"))
    block = F.coalesce(known, F.element_at(F.split("element", ":"), -1))
    ok = facts.where(F.col("element").contains("TextBlock") & (F.length("text") > 50)).withColumn("block", block)
    return ok.groupBy(*keys, "block").agg(F.max_by("text", "pos").alias("text")).withColumn("n_chars", F.length("text"))


def keyword_in_context(docs: DataFrame, keywords: list[str], around: int = 40, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(ident, keyword, occurrence, start, snippet) of each match of each pattern, whatever its case.

    The text between matches tells where they are: the lengths of the pieces that the pattern splits it into are summed up."""
    each = docs.select(F.col(ident), F.col(text).alias("_t"), F.explode(F.array(*[F.lit(k) for k in keywords])).alias("keyword"))
    pattern = F.concat(F.lit("(?i)("), F.col("keyword"), F.lit(")"))
    found = each.withColumn("_m", F.regexp_extract_all("_t", pattern, F.lit(0))).where(F.size("_m") > 0).withColumn("_p", F.expr("split(_t, concat('(?i)(', keyword, ')'), -1)"))
    # one fold over a text's matches gives all places; only places and snippets are exploded, not the text
    pairs = F.arrays_zip(F.slice("_p", 1, F.size("_m")).alias("p"), F.col("_m").alias("m"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, n: int>>").alias("hits"))
    step = lambda a, x: F.struct((a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"), F.array_append(a["hits"], F.struct((a["at"] + F.length(x["p"])).alias("start"), F.length(x["m"]).alias("n"))).alias("hits"))
    left = lambda h: F.greatest(F.lit(0), h["start"] - around)
    shown = lambda h: F.struct(h["start"].alias("start"), F.substring(F.col("_t"), left(h) + 1, h["start"] + h["n"] + around - left(h)).alias("snippet"))
    hits = F.transform(F.aggregate(pairs, first, step, lambda a: a["hits"]), shown)
    return found.select(ident, "keyword", F.posexplode(hits).alias("occurrence", "_h")).select(ident, "keyword", "occurrence", "_h.start", "_h.snippet")


def plan_targets(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentions of medium-term plans with the amounts and fiscal years near them."""
    # fixed values: words of plans and targets
    words = ["中期経営計画", "中期.*計画", "営業利益.*目標", "目標.*営業利益", r"20\d{2}年.*目標", r"\d+億円.*目標", r"FY20\d{2}"]
    hits = keyword_in_context(docs, words, 300, text, ident)
    amounts = F.transform(F.regexp_extract_all("snippet", F.lit(r"営業利益[^\d]*?(\d+(?:,\d+)*)\s*億円"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("long"))
    years = F.transform(F.regexp_extract_all("snippet", F.lit(r"(?:FY)?20(\d{2})年?"), F.lit(1)), lambda y: F.concat(F.lit("FY20"), y))
    return hits.select(ident, "keyword", "start", amounts.alias("amounts"), years.alias("fiscal_years")).where("size(amounts) > 0 or size(fiscal_years) > 0")


# Fields of a report that hold R&D directly, and words in the labels of its other fields.
REPORT_RD = ["research_and_development_expense", "research_and_development_expenses", "research_and_development_cost", "research_and_development_costs", "rd_expense", "r_and_d_expense"]
REPORT_RD_KEYS = [
    "researchanddevelopmentexpense", "researchanddevelopmentexpenses", "researchanddevelopmentcost", "researchanddevelopmentcosts", "researchanddevelopmentexpenditure",
    "researchanddevelopmentexpenditures", "researchanddevelopmentamount", "randdexpense", "randdcost",
]
REPORT_SALES_KEYS, REPORT_SALES_NOT = ["netsales", "revenue", "sales", "operatingrevenue"], ["costofsales", "costsales"]


def report_rd_sales(reports: DataFrame) -> DataFrame:
    """(filing_id, rd_expense, sales) of reports: filing_id, net_sales, direct (fields by name) and other (fields by label), as text.

    R&D is among the direct fields and the labels that name it, sales are net_sales and labels of sales but not of their
    cost; text blocks don't count. Of several candidates the largest by absolute value counts, of equal ones the positive one, as maps have no order."""
    entries = F.map_entries(F.coalesce("other", F.create_map().cast("map<string,string>")))
    labelled = F.filter(F.transform(entries, lambda e: F.struct(label(e["key"]).alias("k"), X.finite(e["value"]).alias("v"))), lambda e: (e["k"] != "") & ~e["k"].contains("textblock") & e["v"].isNotNull())
    values = lambda test: F.transform(F.filter(labelled, lambda e: test(e["k"])), lambda e: e["v"])
    direct = F.array_compact(F.array(*[X.finite(F.element_at("direct", F.lit(f))) for f in REPORT_RD]))
    rd = F.concat(F.coalesce(direct, F.array().cast("array<double>")), values(lambda k: has_any(k, REPORT_RD_KEYS)))
    sales = F.concat(F.array_compact(F.array(X.finite(F.col("net_sales")))), values(lambda k: has_any(k, REPORT_SALES_KEYS) & ~has_any(k, REPORT_SALES_NOT)))
    most = lambda c: F.array_max(F.transform(c, lambda v: F.struct(F.abs(v).alias("a"), v.alias("v"))))["v"]
    return reports.select("filing_id", most(rd).alias("rd_expense"), most(sales).alias("sales"))


def filer_keys(mapping: DataFrame, name: str, key: str) -> DataFrame:
    """(name, key): of each name in capitals the last filer key by ordinal; keys are digits, padded to ten."""
    ok = mapping.select(F.upper(F.trim(F.col(name))).alias(name), X.padded_cik(F.col(key).cast("string")).alias(key), "ordinal").where(F.col(key).isNotNull() & (F.col(name) != ""))
    return ok.groupBy(name).agg(F.max_by(key, "ordinal").alias(key))


def filers(specs: DataFrame, mapping: DataFrame, name: str, key: str) -> DataFrame:
    """specs with the key of their filer; those that the mapping lacks are dropped."""
    keys = filer_keys(mapping, name, key).withColumnRenamed(name, "_name")
    return specs.join(keys, F.upper(F.trim(F.col(name))) == F.col("_name")).drop("_name")


def match_documents(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """Documents of wanted stock codes, each docID once: the first by submission, unknown times last, then code."""
    wanted = codes.select(X.stock_code(F.col("stock_code")).alias("code")).distinct()
    d = docs.withColumn("code", X.stock_code(F.col("secCode"))).join(wanted, "code", "left_semi")
    first = d.groupBy("docID").agg(F.min(F.struct(F.col("submitDateTime").isNull().alias("unknown"), "submitDateTime", "code")).alias("x"))
    return first.select("docID", "x.submitDateTime", "x.code")


def filing_index(listings: DataFrame) -> DataFrame:
    """Listings with each docID of a day once, the first by type (120 before 130) and place; rows with a blank docID stay."""
    order = Window.partitionBy("day", "docID").orderBy("docType", "pos")
    numbered = listings.where(F.col("docType").isin("120", "130")).withColumn("_n", F.row_number().over(order))
    return numbered.where("_n = 1 or docID is null or trim(docID) = ''").drop("_n")


def unwrap_payload(payloads: DataFrame, element: str) -> DataFrame:
    """Rows under the first present of results, rows, records, xbrl_rows and data, or of an array itself. payloads: file, payload. element: the rows' type as DDL."""
    keys = ["results", "rows", "records", "xbrl_rows", "data"]
    wrapped = F.from_json("payload", "struct<" + ", ".join(f"{k}: array<{element}>" for k in keys) + ">")
    bare = F.when(F.trim("payload").startswith("["), F.from_json("payload", f"array<{element}>"))
    rows = F.coalesce(bare, *[wrapped[k] for k in keys])
    return payloads.select("file", F.posexplode(F.coalesce(rows, F.raise_error(F.lit("no rows in payload")).cast(f"array<{element}>"))).alias("pos", "r")).select("file", "pos", "r.*")
