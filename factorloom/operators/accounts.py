"""The catalogue of accounts: which elements of a filing count, and for which kind of period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .temporal import dates_side

# Accounts of the filing taxonomy by the kind of period for which their values count.
ACCOUNTS = {
    "filing": [
        "jpcrp_cor:FilingDateCoverPage", "jpdei_cor:SecurityCodeDEI", "jpcrp_cor:FiscalYearCoverPage", "jpdei_cor:CurrentFiscalYearStartDateDEI", "jpdei_cor:CurrentFiscalYearEndDateDEI",
        "jpdei_cor:AccountingStandardsDEI", "jpdei_cor:WhetherConsolidatedFinancialStatementsArePreparedDEI",
    ],
    "instant": [
        "jpcrp_cor:NumberOfEmployees", "jpcrp_cor:AverageNumberOfTemporaryWorkers", "jpcrp_cor:AverageAgeYearsInformationAboutReportingCompanyInformationAboutEmployees",
        "jpcrp_cor:AverageLengthOfServiceYearsInformationAboutReportingCompanyInformationAboutEmployees", "jpcrp_cor:AverageAnnualSalaryInformationAboutReportingCompanyInformationAboutEmployees",
        "jpcrp_cor:NumberOfSharesHeld", "jpcrp_cor:ShareholdingRatio", "jpcrp_cor:TotalNumberOfIssuedSharesSummaryOfBusinessResults", "jpcrp_cor:NumberOfConsolidatedSubsidiaries",
        "jpcrp_cor:NetAssetsPerShareSummaryOfBusinessResults", "jpcrp_cor:EquityToAssetRatioSummaryOfBusinessResults", "jpcrp_cor:CashAndCashEquivalentsSummaryOfBusinessResults", "jppfs_cor:Assets",
        "jppfs_cor:CurrentAssets", "jppfs_cor:NoncurrentAssets", "jppfs_cor:PropertyPlantAndEquipment", "jppfs_cor:IntangibleAssets", "jppfs_cor:InvestmentsAndOtherAssets", "jppfs_cor:Liabilities",
        "jppfs_cor:CurrentLiabilities", "jppfs_cor:ShortTermLoansPayable", "jppfs_cor:CurrentPortionOfBonds", "jppfs_cor:CurrentPortionOfLongTermLoansPayable", "jppfs_cor:NoncurrentLiabilities",
        "jppfs_cor:BondsPayable", "jppfs_cor:ConvertibleBondTypeBondsWithSubscriptionRightsToShares", "jppfs_cor:CommercialPapersLiabilities", "jppfs_cor:LongTermLoansPayable", "jppfs_cor:NetAssets",
        "jppfs_cor:ShareholdersEquity", "jppfs_cor:CapitalStock", "jppfs_cor:CapitalSurplus", "jppfs_cor:RetainedEarnings", "jppfs_cor:TreasuryStock", "jppfs_cor:ValuationAndTranslationAdjustments",
    ],
    "duration": [
        "jppfs_cor:NetSales", "jppfs_cor:CostOfSales", "jppfs_cor:GrossProfit", "jppfs_cor:SellingGeneralAndAdministrativeExpenses", "jppfs_cor:SalariesAndAllowancesSGA", "jppfs_cor:DepreciationSGA",
        "jppfs_cor:ResearchAndDevelopmentExpensesSGA", "jppfs_cor:OperatingIncome", "jppfs_cor:NonOperatingIncome", "jppfs_cor:NonOperatingExpenses", "jppfs_cor:InterestExpensesNOE",
        "jppfs_cor:OrdinaryIncome", "jppfs_cor:ExtraordinaryIncome", "jppfs_cor:ExtraordinaryLoss", "jppfs_cor:IncomeBeforeIncomeTaxes", "jppfs_cor:IncomeTaxes", "jppfs_cor:ProfitLoss",
        "jppfs_cor:ProfitLossAttributableToOwnersOfParent", "jpcrp_cor:ComprehensiveIncomeSummaryOfBusinessResults", "jpcrp_cor:BasicEarningsLossPerShareSummaryOfBusinessResults",
        "jpcrp_cor:DilutedEarningsPerShareSummaryOfBusinessResults", "jpcrp_cor:DividendPaidPerShareSummaryOfBusinessResults", "jpcrp_cor:PriceEarningsRatioSummaryOfBusinessResults",
        "jpcrp_cor:RateOfReturnOnEquitySummaryOfBusinessResults", "jppfs_cor:NetCashProvidedByUsedInOperatingActivities", "jppfs_cor:DepreciationAndAmortizationOpeCF",
        "jppfs_cor:NetCashProvidedByUsedInInvestmentActivities", "jppfs_cor:NetCashProvidedByUsedInFinancingActivities", "jppfs_cor:NetIncreaseDecreaseInCashAndCashEquivalents",
    ],
}


def catalogue(spark: SparkSession) -> DataFrame:
    """(element, kind) of ACCOUNTS, a small dimension; any other table of these columns does as well."""
    return spark.createDataFrame([(e, kind) for kind, names in ACCOUNTS.items() for e in names], "element string, kind string")


def catalogued(facts: DataFrame, accounts: DataFrame) -> DataFrame:
    """facts (element, context, period, ...) of the accounts in the catalogue (element, kind) whose context or period is of the account's kind, with kind.

    A filing date is a kind of its own, told by the context; else an instant or a duration is told by the context, and
    by the period where the context says neither. Elements that the catalogue lacks go, as do values of a wrong kind."""
    context, period = F.lower(F.coalesce("context", F.lit(""))), F.lower(F.coalesce("period", F.lit("")))
    said = F.when(context.contains("filingdate"), "filing")
    for text in (context, period):
        for kind in ("instant", "duration"):
            said = said.when(text.contains(kind), kind)
    return facts.withColumn("kind", said).join(dates_side(accounts.select("element", "kind").distinct()), ["element", "kind"])
