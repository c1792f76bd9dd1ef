"""Unnesting sales, and the flat table of sold items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_sales(raw: DataFrame) -> DataFrame:
    """One row per element of ``Sales``; records without any disappear."""
    kept = [c for c in raw.columns if c != "Sales"]
    return raw.select(*kept, F.explode("Sales").alias("Sales_Details"))


def sale_items(sales: DataFrame) -> DataFrame:
    """One flat row per sold item; sales without items disappear.

    Once two fields of an item are used, a scan of the nested column reads all
    of them, and a filter on an item never reaches the file. Stored flat and
    partitioned by ``sale_date``, both work; the reports take this shape.
    """
    sale = F.col("Sales_Details")
    return sales.select(
        "venue_id",
        "venue_name",
        sale["Transaction_Date"].alias("transaction_date"),
        sale["Member_Id"].alias("member_id"),
        sale["Member_Name"].alias("member_name"),
        F.explode(sale["Items"]).alias("item"),
    ).select(
        F.to_date("transaction_date").alias("sale_date"),
        "venue_id",
        "venue_name",
        "transaction_date",
        "member_id",
        "member_name",
        F.col("item.Product_Name").alias("product_name"),
        F.col("item.Master_Group_Id").alias("master_group_id"),
        F.col("item.Quantity").alias("quantity"),
        F.col("item.Total_Inc").alias("total_inc"),
    )


def venue_dimension(sales: DataFrame) -> DataFrame:
    """One name per venue id; the least one if a venue was ever renamed."""
    return _names(sales).groupBy("venue_id").agg(F.min("venue_name").alias("venue_name"))


def venue_name_of(sales: DataFrame, venue_id: int) -> DataFrame:
    """A single row with the venue's name, NULL when it is unknown."""
    names = _names(sales.where(F.col("venue_id") == venue_id))
    return names.agg(F.min("venue_name").alias("venue_name"))


def _names(sales: DataFrame) -> DataFrame:
    """The few (id, name) pairs there are.

    The least of a text column aggregates by sorting its input, here all sales;
    grouping by the pair hashes and leaves a handful of rows to sort. The filter
    on the count keeps the optimizer from merging the two aggregations again.
    """
    pairs = sales.groupBy("venue_id", "venue_name").agg(F.count(F.lit(1)).alias("rows"))
    return pairs.where(F.col("rows") > 0)
