"""Tagging rows with their tenant, and the coverage of the tags."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matterlake.plans.skew import top_per_group


def member_firm(firm_users: DataFrame) -> DataFrame:
    """One firm per active user: the earliest membership, then the smallest id."""
    active = firm_users.where(F.col("status") == "active")
    first = top_per_group(
        active, ["user_id"], [F.col("added_at").asc(), F.col("firm_id").asc()], 1
    )
    return first.select("user_id", F.col("firm_id").alias("_member_firm"))


def tag_firm(df: DataFrame, firm_users: DataFrame) -> DataFrame:
    """Fill a missing ``firm_id`` through the row's user."""
    filled = F.coalesce("firm_id", "_member_firm").alias("firm_id")
    return df.join(member_firm(firm_users), "user_id", "left").select(
        *[filled if c == "firm_id" else F.col(c) for c in df.columns]
    )


def tag_firm_by_matter(df: DataFrame, matters: DataFrame) -> DataFrame:
    """Fill a missing ``firm_id`` through the parent matter."""
    parents = matters.where(F.col("firm_id").isNotNull()).select(
        F.col("id").alias("matter_id"), F.col("firm_id").alias("_parent_firm")
    )
    filled = F.coalesce("firm_id", "_parent_firm").alias("firm_id")
    return df.join(parents, "matter_id", "left").select(
        *[filled if c == "firm_id" else F.col(c) for c in df.columns]
    )


def tag_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and tagged rows of each table, one row per table."""
    parts = [
        table.agg(
            F.count(F.lit(1)).alias("total"), F.count("firm_id").alias("firm_tagged")
        ).select(F.lit(name).alias("table_name"), "total", "firm_tagged")
        for name, table in tables.items()
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
