"""Chat history: what of it goes into the search query and into the prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turns that feed the query, turns that are shown.
QUERY_TURNS, SHOWN_TURNS = 4, 6


def _last(turns: DataFrame, n: int) -> DataFrame:
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)


def query_fold(turns: DataFrame) -> DataFrame:
    """(conv_id, query): the user's texts among the last turns, in order."""
    rows = _last(turns, QUERY_TURNS).where("role = 'user'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("query"))


def transcript(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): the last turns as lines."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    rows = _last(turns, SHOWN_TURNS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(who, "text").alias("line")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("transcript"))
