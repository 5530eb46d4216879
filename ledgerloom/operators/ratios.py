"""Financial ratios: figures found by synonyms of their names, and quotients of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import normal

#: Ratio name, numerator key, denominator key.
RATIOS = (
    ("Current Ratio", "current_assets", "current_liabilities"), ("Quick Ratio", "current_assets", "current_liabilities"), ("Cash Ratio", "cash", "current_liabilities"),
    ("Debt to Equity", "total_liabilities", "equity"), ("Debt Ratio", "total_liabilities", "total_assets"), ("Long-term Debt to Equity", "long_term_liabilities", "equity"),
    ("Asset Turnover", "revenue", "total_assets"), ("Inventory Turnover", "cogs", "inventory"), ("Receivables Turnover", "revenue", "current_assets"), ("ROA", "net_income", "total_assets"),
    ("ROE", "net_income", "equity"), ("Net Profit Margin", "net_income", "revenue"), ("Gross Profit Margin", "gross_profit", "revenue"), ("Operating Margin", "ebit", "revenue"),
    ("Operating Cash Flow Ratio", "operating_cash_flow", "current_liabilities"), ("EPS", "net_income", "shares"), ("P/E", "share_price", "eps"), ("P/B", "share_price", "bvps"),
)
#: Accent-free synonyms of each key, in order of preference.
SYNONYMS = {
    "equity": ("von chu so huu", "von chu", "owner's equity", "equity", "share capital"), "current_liabilities": ("no ngan han", "short-term liabilities", "current liabilities"),
    "long_term_liabilities": ("no dai han", "long-term liabilities"), "total_liabilities": ("tong no phai tra", "no phai tra", "total liabilities"),
    "current_assets": ("tai san ngan han", "current assets", "current asset"), "total_assets": ("tong tai san", "tai san", "total assets"), "revenue": ("doanh thu thuan", "doanh thu", "revenue", "net revenue"),
    "cogs": ("gia von hang ban", "cogs", "cost of goods sold"), "inventory": ("hang ton kho", "inventory"), "net_income": ("loi nhuan sau thue", "loi nhuan", "net profit after tax", "net income"),
    "gross_profit": ("loi nhuan gop", "gross profit"), "ebit": ("loi nhuan thuan tu hoat dong kinh doanh", "ebit", "operating profit"), "cash": ("tien va tuong duong tien", "cash and cash equivalents"),
    "operating_cash_flow": ("luu chuyen tien thuan tu hoat dong kinh doanh", "operating cash flow", "cash flow from operations"), "shares": ("so co phieu luu hanh", "so co phieu", "shares outstanding"),
    "share_price": ("gia co phieu", "share price", "market price per share"), "bvps": ("gia tri so sach tren moi co phieu", "book value per share", "bvps"),
}


#: Accent-free names of the columns with the figures of a period.
PERIOD_COLUMNS = {"end": ("so cuoi nam", "onv s6 cuoi nam", "nam nay", "end of year", "year end", "ending balance"), "begin": ("so dau nam", "nam truoc", "nam truroc", "beginning of year", "opening balance")}


def period_columns(names: list[str], synonyms: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """The leftmost column of each period, by a synonym in its accent-free name; a period without one is left out. Reads the schema only."""
    from ledgerloom.sources.readers import plain_name

    out: dict[str, str] = {}
    for period, words in (synonyms or PERIOD_COLUMNS).items():
        hit = next((n for n in names if any(w in plain_name(n) for w in words)), None)
        if hit is not None:
            out[period] = hit
    return out


def synonym_table(spark: SparkSession, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(k, s, i) for k, words in synonyms.items() for i, s in enumerate(words)], "key string, synonym string, syn_ord int")


def found_values(rows: DataFrame, file: list[str], label: str, value: str, position: str, synonyms: DataFrame) -> DataFrame:
    """For each file and key the first row whose label holds a synonym: by order of synonyms, then of rows. Labels are matched without accents.

    The synonym table is configuration of a few dozen rows and is broadcast; the match is a containment test.
    """
    plain = rows.withColumn("__plain", F.translate(normal(F.col(label)), "đ", "d"))
    met = plain.join(F.broadcast(synonyms), F.col("__plain").contains(F.col("synonym")))
    first = Window.partitionBy(*file, "key").orderBy("syn_ord", position)
    return met.withColumn("__at", F.row_number().over(first)).where("__at = 1").select(*file, "key", F.col(value).alias("value"))


def ratio_values(found: DataFrame, file: list[str], ratios: DataFrame, digits: int = 4) -> DataFrame:
    """ratio of each file that has both figures, neither of them 0."""
    top = found.select(*file, F.col("key").alias("numerator"), F.col("value").alias("__top"))
    bottom = found.select(*file, F.col("key").alias("denominator"), F.col("value").alias("__bottom"))
    joined = top.join(F.broadcast(ratios), "numerator").join(bottom, [*file, "denominator"])
    return joined.where("__top <> 0 and __bottom <> 0").select(*file, "ratio", F.round(F.col("__top") / F.col("__bottom"), digits).alias("ratio_value"))


def ratio_table(spark: SparkSession, ratios: tuple = RATIOS) -> DataFrame:
    return spark.createDataFrame(list(ratios), "ratio string, numerator string, denominator string")


def wide(values: DataFrame, file: list[str], names: list[str]) -> DataFrame:
    """One row for each file, one column for each ratio."""
    return values.groupBy(*file).pivot("ratio", names).agg(F.first("ratio_value"))
