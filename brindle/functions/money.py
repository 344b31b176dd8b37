"""Column expressions for invoices in integer cents, and reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def net_cents(quantity: Column, unit_price: Column, discount_pct: Column) -> Column:
    """quantity times price less discount, rounded to a cent."""
    return F.round(quantity * unit_price * (F.lit(100) - discount_pct) / 100.0).cast("long")


def gross_cents(net: Column, tax_pct: Column) -> Column:
    return F.round(net * (F.lit(100) + tax_pct) / 100.0).cast("long")


def invoice_totals(positions: DataFrame) -> DataFrame:
    """positions (invoice_id, quantity, unit_price, discount_pct, tax_rate): net and gross of each invoice."""
    net = net_cents(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    rows = positions.withColumn("net", net).withColumn("gross", gross_cents(F.col("net"), F.col("tax_rate")))
    return rows.groupBy("invoice_id").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"))


def balance_due(totals: DataFrame, payments: DataFrame) -> DataFrame:
    """gross less payments of each invoice; an invoice without payments owes all."""
    paid = payments.groupBy("invoice_id").agg(F.sum("amount").alias("paid"))
    zero = F.lit(0).cast("long")
    return totals.join(paid, "invoice_id", "left").select("invoice_id", "gross", F.coalesce("paid", zero).alias("paid"), (F.col("gross") - F.coalesce("paid", zero)).alias("due"))


def top_customers(totals: DataFrame, invoices: DataFrame, n: int) -> DataFrame:
    """invoices (invoice_id, customer_id): the n customers with the largest gross, ties by id."""
    return totals.join(invoices, "invoice_id").groupBy("customer_id").agg(F.sum("gross").alias("gross"), F.count("*").alias("invoices")).orderBy(F.desc("gross"), "customer_id").limit(n)
