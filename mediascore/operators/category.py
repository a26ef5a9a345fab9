"""The category -> column map (C6), built by Spark from the category schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_names(schema_rows: DataFrame) -> DataFrame:
    """(original_column, pos, name, category) of (original_column,
    column_names): the column's own prefix is stripped, else the text after the
    first '_' is the category, else it is null (the name maps nothing)."""
    ex = schema_rows.select("original_column", F.posexplode("column_names").alias("pos", "name"))
    prefix = F.concat(F.col("original_column"), F.lit("_"))
    cat = (
        F.when(F.startswith(F.col("name"), prefix), F.substr(F.col("name"), F.length(prefix) + 1))
        .when(F.instr(F.col("name"), "_") > 0, F.substr(F.col("name"), F.instr(F.col("name"), "_") + 1))
    )
    return ex.withColumn("category", cat)


def category_map_table(schema_rows: DataFrame) -> DataFrame:
    """(original_column, category, column_name, first_pos): of names with the
    same category the last wins, at the first one's place."""
    return (
        category_names(schema_rows).where(F.col("category").isNotNull())
        .groupBy("original_column", "category")
        .agg(F.max_by("name", "pos").alias("column_name"), F.min("pos").alias("first_pos"))
    )
