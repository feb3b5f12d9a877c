"""Money as integer cents, so that sums do not depend on the order of rows."""

from pyspark.sql import Column, functions as F


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def line_revenue_cents(price: Column, discount: Column) -> Column:
    return cents(price * (1 - discount))
