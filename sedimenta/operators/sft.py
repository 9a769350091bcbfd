"""Table questions as prompts, and fine-tuning splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Aggregate and comparison names by their number in a question.
AGGREGATES = ("", "MAX", "MIN", "COUNT", "SUM", "AVG")
COMPARISONS = ("=", ">", "<", "OP")


def join_wikisql(questions: DataFrame, tables: DataFrame, check: bool = True) -> DataFrame:
    """Each question with its table's header and types; an error if a table is missing. Spark broadcasts the tables if they
    are small, by its own threshold."""
    meta = tables.select(F.col("id").alias("table_id"), "header", "types")
    if check:
        lost = questions.join(meta, "table_id", "left_anti").select("table_id").head(1)
        if lost:
            raise ValueError(f"no table {lost[0][0]}")
    return questions.join(meta, "table_id")


def wikisql_text(df: DataFrame, out: str = "text") -> DataFrame:
    """Add sql_text and the prompt. A value is quoted if its column's type is text; nothing is escaped."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    sel, agg = F.col("sql.sel"), F.col("sql.agg")

    def condition(c):
        column, kind = F.get("header", c[0].cast("int")), F.get("types", c[0].cast("int"))
        value = F.when(kind == "text", F.concat(F.lit("'"), c[2], F.lit("'"))).otherwise(c[2])
        return F.concat_ws(" ", column, pick(COMPARISONS, c[1].cast("int")), value)

    where = F.when(F.size("sql.conds") > 0, F.concat(F.lit(" WHERE "), F.array_join(F.transform("sql.conds", condition), " AND "))).otherwise("")
    what = F.when(agg > 0, F.concat(pick(AGGREGATES, agg), F.lit(" "))).otherwise("")
    text = F.concat(F.lit("SELECT "), what, F.get("header", sel), F.lit(" FROM "), F.col("table_id"), where)
    prompt = F.concat(F.lit("table: "), F.col("table_id"), F.lit("\ncolumns: "), F.array_join("header", ", "), F.lit("\nQ: "), F.col("question"), F.lit("\nA: "), F.col("sql_text"))
    return df.withColumn("sql_text", text).withColumn(out, prompt)


def take_splits(df: DataFrame, sizes: dict[str, int], split: str = "split", order: str = "position") -> DataFrame:
    """The first rows of each split, by position; splits that aren't named go. A limit per split is a bounded top-k."""
    parts = [df.where(F.col(split) == name).orderBy(order).limit(max(n, 0)) for name, n in sizes.items()]
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0)


def union_splits(**splits: DataFrame) -> DataFrame:
    """One table of all splits, tagged with their names."""
    return reduce(DataFrame.unionByName, (df.withColumn("split", F.lit(name)) for name, df in splits.items()))


def first_per_group(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("n") <= n).drop("n")
