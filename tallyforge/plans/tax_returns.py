"""Tax-return XML to one row of 110 columns per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import blank_to_null, strip_leading_junk, text_flag, xml_record
from ..registry import on_tables

c = F.col

# Field names of the forms, in the order of the output; FLAGS are yes/no fields.
FIELDS = (
    "AuditedFinancialStatements", "BalanceSheetAmountsReported", "BenefitsPaidToMembersCY", "CollectionsOfArt", "ConservationEasements",
    "ContributionsGrantsCurrentYear", "ContributionsGrantsPriorYear", "CreditCounseling", "DonorAdvisedFunds", "ForeignActivities", "ForeignOffice",
    "FundraisingActivities", "Gaming", "GrantsAndSimilarAmntsCY", "GrantsToIndividuals", "GrantsToOrganizations", "Hospital",
    "InvestmentIncomeCurrentYear", "MembershipDues", "MoreThan5000KToIndividuals", "MoreThan5000KToOrganizations", "NetAssetsOrFundBalancesBOY",
    "NetAssetsOrFundBalancesEOY", "NetUnrelatedBusinessTxblIncome", "OtherExpensePriorYear", "OtherExpensesCurrentYear", "OtherRevenueCurrentYear",
    "OtherRevenuePriorYear", "PoliticalActivities", "ProfessionalFundraising", "ProgramServiceRevenueCY", "ProgramServiceRevenuePriorYear",
    "Revenue", "RevenuesLessExpensesCY", "RevenuesLessExpensesPriorYear", "SalariesEtcCurrentYear", "SalariesEtcPriorYear", "School",
    "SubjectToProxyTax", "TermOrPermanentEndowments", "TotalAssetsBOY", "TotalAssetsEOY", "TotalExpenses", "TotalExpensesCurrentYear",
    "TotalExpensesPriorYear", "TotalFundrsngExpCurrentYear", "TotalGrossUBI", "TotalLiabilitiesBOY", "TotalLiabilitiesEOY", "TotalNbrEmployees",
    "TotalNbrVolunteers", "TotalProfFundrsngExpCY", "TotalRevenueCurrentYear", "TotalRevenuePriorYear",
)
FLAGS = (
    "AuditedFinancialStatements", "BalanceSheetAmountsReported", "CollectionsOfArt", "ConservationEasements", "CreditCounseling",
    "DonorAdvisedFunds", "ForeignActivities", "ForeignOffice", "FundraisingActivities", "Gaming", "GrantsToIndividuals", "GrantsToOrganizations",
    "Hospital", "MoreThan5000KToIndividuals", "MoreThan5000KToOrganizations", "PoliticalActivities", "ProfessionalFundraising", "School",
    "SubjectToProxyTax", "TermOrPermanentEndowments",
)
PF_REVENUE = (
    "ContriReceivedRevAndExpnss", "InterestOnSavingsRevAndExpnss", "InterestOnSavingsNetInvstIncm", "DividendsRevAndExpnss", "DividendsNetInvstIncm",
    "CapitalGainNetIncmNetInvstIncm", "TotalRevenueAndExpenses", "TotalNetInvestmentIncome", "CompOfcrDirTrstRevAndExpnss",
    "CompOfcrDirTrstNetInvstIncm", "CompOfcrDirTrstDsbrsChrtblPrps", "AccountingFeesRevAndExpnss", "AccountingFeesNetInvstIncm",
    "AccountingFeesDsbrsChrtblPrps", "TaxesRevAndExpnss", "TaxesNetInvstIncm", "TaxesDsbrsChrtblPrps", "OtherExpensesRevAndExpnss",
    "OtherExpensesNetInvstIncm", "OtherExpensesDsbrsChrtblPrps", "TotOprExpensesRevAndExpnss", "TotOprExpensesNetInvstIncm",
    "TotOprExpensesDsbrsChrtblPrps", "ContriGiftsPaidRevAndExpnss", "ContriGiftsPaidDsbrsChrtblPrps", "TotalExpensesRevAndExpnss",
    "TotalExpensesNetInvstIncm", "TotalExpensesDsbrsChrtblPrps", "ExcessOfRevenueOverExpenses", "NetInvestmentIncome",
)
PF_BALANCE = (
    "CashBOY", "CashEOY", "CashEOYFMV", "InvestmentsOtherBOY", "InvestmentsOtherEOY", "InvestmentsOtherEOYFMV", "TotalAssetsBOY", "TotalAssetsEOY",
    "TotalAssetsEOYFMV", "TotalLiabilitiesBOY", "TotalLiabilitiesEOY", "OrgThatDoNotFollowSFAS117", "CapitalStockBOY", "CapitalStockEOY",
    "PaidInOrCapitalSurplusBOY", "PaidInOrCapitalSurplusEOY", "RetainedEarningsBOY", "RetainedEarningsEOY", "TotalNetAssetsBOY", "TotalNetAssetsEOY",
    "TotalLiabilitiesNetAssetsBOY", "TotalLiabilitiesNetAssetsEOY",
)
TEXT_FIELDS = ("OrgThatDoNotFollowSFAS117",)
FORMS = ("990", "990EZ", "990PF")


def _texts(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _schema() -> T.StructType:
    header = _texts(["TaxYear", "TaxYr", "ReturnType", "ReturnTypeCd"]).add(
        "Filer", _texts(["EIN"]).add("Name", _texts(["BusinessNameLine1"])))
    form = _texts(FIELDS).add("AnalysisOfRevenueAndExpenses", _texts(PF_REVENUE)).add("BalanceSheets", _texts(PF_BALANCE))
    data = T.StructType([T.StructField(f"IRS{f}", form) for f in FORMS])
    return T.StructType([T.StructField("_returnVersion", T.StringType()), T.StructField("ReturnHeader", header), T.StructField("ReturnData", data)])


def extract_returns(documents: DataFrame, *keep: str) -> DataFrame:
    """``documents`` holds a column ``text``; each document is parsed once.

    Headers changed names with 2013. Return fields are looked up by their earlier names
    only, so later documents give mostly nulls, as in the system this follows.
    """
    parsed = documents.select(*keep, xml_record(strip_leading_junk(c("text")), _schema()).alias("d"))
    early = F.substring("d._returnVersion", 1, 4).cast("int") < 2013
    head = lambda before, after: F.when(early, c(f"d.ReturnHeader.{before}")).otherwise(c(f"d.ReturnHeader.{after}"))
    named = parsed.select(*keep, "d", early.alias("early"), head("ReturnType", "ReturnTypeCd").alias("kind"), head("TaxYear", "TaxYr").alias("year"))
    form = F.coalesce(*[F.when(c("kind") == f, c(f"d.ReturnData.IRS{f}")) for f in FORMS])
    rows = named.select(*keep, "d", "early", "kind", "year", form.alias("f"))
    text = lambda path: blank_to_null(c(path))
    private = lambda path: F.when(c("kind") == "990PF", text(path))
    columns = [c("d.ReturnHeader.Filer.EIN").cast("bigint").alias("EIN"), F.when(c("early"), c("d.ReturnHeader.Filer.Name.BusinessNameLine1")).alias("BusinessName"),
               c("year").cast("bigint").alias("TaxYear"), c("kind").alias("ReturnType")]
    columns += [(text_flag(text(f"f.{n}")) if n in FLAGS else text(f"f.{n}").cast("bigint")).alias(n) for n in FIELDS]
    columns += [private(f"f.AnalysisOfRevenueAndExpenses.{n}").cast("bigint").alias(f"PF{n}") for n in PF_REVENUE]
    columns += [(private(f"f.BalanceSheets.{n}") if n in TEXT_FIELDS else private(f"f.BalanceSheets.{n}").cast("bigint")).alias(f"PF{n}") for n in PF_BALANCE]
    return rows.select(*keep, *columns)


def _documents(t) -> DataFrame:
    """One return per order with all its fields: the form by key, old and new headers in turn."""
    k = c("o_orderkey")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    text = lambda value: value.cast("string")
    early = k % 2 == 0
    kind = F.when(k % 3 == 0, "990").when(k % 3 == 1, "990EZ").otherwise("990PF")
    filer = tag("Filer", F.concat(tag("EIN", text(c("o_custkey"))), tag("Name", tag("BusinessNameLine1", c("o_orderpriority")))))
    header = F.when(early, F.concat(tag("ReturnType", kind), tag("TaxYear", F.lit("2011")))).otherwise(F.concat(tag("ReturnTypeCd", kind), tag("TaxYr", F.lit("2014"))))
    flag = lambda i: F.when((k + i) % 5 == 0, "1").when((k + i) % 5 == 1, "false").otherwise("")
    value = lambda i, name: flag(i) if name in FLAGS else F.lit("X") if name in TEXT_FIELDS else text(k + i)
    inside = lambda names: F.concat(*[tag(n, value(i, n)) for i, n in enumerate(names)])
    fields = F.concat(inside(FIELDS), tag("AnalysisOfRevenueAndExpenses", inside(PF_REVENUE)), tag("BalanceSheets", inside(PF_BALANCE)))
    body = F.concat(F.lit("<IRS"), kind, F.lit(">"), fields, F.lit("</IRS"), kind, F.lit(">"))
    root = F.concat(F.lit('?? <Return returnVersion="'), F.when(early, "2011v1.2").otherwise("2014v5.0"), F.lit('">'),
                    tag("ReturnHeader", F.concat(filer, header)), tag("ReturnData", body), F.lit("</Return>"))
    return t.orders.select(k.alias("doc"), root.alias("text"))


def _places(names, test) -> list[int]:
    return [i for i, n in enumerate(names) if test(n)]


_AMOUNTS, _FLAG_PLACES = _places(FIELDS, lambda n: n not in FLAGS), _places(FIELDS, lambda n: n in FLAGS)
_BALANCES = _places(PF_BALANCE, lambda n: n not in TEXT_FIELDS)
_SUM_SQL = lambda places: f"(o_orderkey * {sum(i + 1 for i in places)} + {sum((i + 1) * i for i in places)})::BIGINT"
_FLAG_SQL = lambda rest: " + ".join(f"CASE WHEN (o_orderkey + {i}) % 5 = {rest} THEN {i + 1} ELSE 0 END" for i in _FLAG_PLACES)


@on_tables("job_04_tax_returns", f"""SELECT o_orderkey AS doc, o_custkey AS EIN, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS BusinessName, CASE WHEN o_orderkey % 2 = 0 THEN 2011 ELSE 2014 END::BIGINT AS TaxYear,
    CASE o_orderkey % 3 WHEN 0 THEN '990' WHEN 1 THEN '990EZ' ELSE '990PF' END AS ReturnType, {_SUM_SQL(_AMOUNTS)} AS amounts, ({_FLAG_SQL(0)})::BIGINT AS yes, ({_FLAG_SQL(1)})::BIGINT AS no,
    CASE WHEN o_orderkey % 3 = 2 THEN {_SUM_SQL(range(len(PF_REVENUE)))} END AS pf_revenue, CASE WHEN o_orderkey % 3 = 2 THEN {_SUM_SQL(_BALANCES)} END AS pf_balance,
    CASE WHEN o_orderkey % 3 = 2 THEN 'X' END AS pf_text, {4 + len(FIELDS) + len(PF_REVENUE) + len(PF_BALANCE)}::BIGINT AS width FROM orders""")
def tax_returns(t):
    """All return fields, each weighted by its place, so that no two can be mixed up unseen."""
    out = extract_returns(_documents(t), "doc")
    total = lambda places, cell: reduce(lambda a, b: a + b, [cell(i) * (i + 1) for i in places])
    field = lambda i: c(FIELDS[i])
    return out.select(
        "doc", "EIN", "BusinessName", "TaxYear", "ReturnType", total(_AMOUNTS, field).alias("amounts"),
        total(_FLAG_PLACES, lambda i: F.coalesce(field(i), F.lit(False)).cast("long")).alias("yes"),
        total(_FLAG_PLACES, lambda i: F.coalesce(~field(i), F.lit(False)).cast("long")).alias("no"),
        total(range(len(PF_REVENUE)), lambda i: c(f"PF{PF_REVENUE[i]}")).alias("pf_revenue"), total(_BALANCES, lambda i: c(f"PF{PF_BALANCE[i]}")).alias("pf_balance"),
        c(f"PF{TEXT_FIELDS[0]}").alias("pf_text"), F.lit(len(out.columns) - 1).cast("long").alias("width"))
