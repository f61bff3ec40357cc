"""Usual business measures as aggregates, undefined ratios NULL. Columns are passed in, so one measure serves any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import count_if, ratio
from .model import growth, prior_year, year_to_date

_rows = lambda: F.count(F.lit(1))

# a measure's name -> its aggregate over columns
HEALTH = {
    "average_length_of_stay": lambda days: ratio(F.sum(days), _rows()),
    "readmission_rate": lambda readmitted: ratio(count_if(readmitted), _rows()),
    "bed_occupancy_rate": lambda occupied, available: ratio(F.sum(occupied), F.sum(available)),
    "satisfaction_score": lambda score: F.avg(score),
    "mortality_rate": lambda status: ratio(count_if(status == "Expired"), _rows()),
    "emergency_wait": lambda minutes: F.avg(minutes),
}
FINANCE = {
    "net_revenue": lambda gross, deductions: F.sum(gross) - F.sum(deductions),
    "gross_margin": lambda gross, cost: ratio(F.sum(gross) - F.sum(cost), F.sum(gross)),
    "operating_expense_ratio": lambda expenses, gross: ratio(F.sum(expenses), F.sum(gross)),
    "budget_variance": lambda actual, budget: F.sum(actual) - F.sum(budget),
    "budget_variance_share": lambda actual, budget: ratio(F.sum(actual) - F.sum(budget), F.sum(budget)),
    "days_sales_outstanding": lambda receivable, gross: ratio(F.sum(receivable), F.sum(gross) / 365),
}
RETAIL = {
    "revenue_per_transaction": lambda revenue: ratio(F.sum(revenue), _rows()),
    "items_per_basket": lambda quantity, transaction: ratio(F.sum(quantity), F.count_distinct(transaction)),
    "conversion_rate": lambda transaction, visits: ratio(F.count_distinct(transaction), F.sum(visits)),
    "inventory_turnover": lambda cost, stock: ratio(F.sum(cost), F.avg(stock)),
    "sell_through_rate": lambda quantity, received: ratio(F.sum(quantity), F.sum(received)),
    "customer_lifetime_value": lambda revenue, customer: ratio(F.sum(revenue), F.count_distinct(customer)),
}


def revenue_over_time(df: DataFrame, date: Column, revenue: Column) -> DataFrame:
    """month, revenue, revenue_ytd, revenue_prior_year, sales_growth."""
    months = df.groupBy(F.trunc(date, "month").alias("month")).agg(F.sum(revenue).alias("revenue"))
    both = prior_year(months, "month", "revenue", "revenue_prior_year")
    return both.select("month", "revenue", year_to_date(F.col("revenue"), "month").alias("revenue_ytd"), "revenue_prior_year", growth(F.col("revenue"), F.col("revenue_prior_year")).alias("sales_growth"))
