"""Usage ledgers: cost, exposure and what reuse avoided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_cost(input_tokens: Column, output_tokens: Column, usd_per_million_in: float, usd_per_million_out: float) -> Column:
    return (input_tokens * usd_per_million_in + output_tokens * usd_per_million_out) / 1e6


def nano_cost(input_units: Column, output_units: Column, per_input: int, per_output: int) -> Column:
    """Integer cost in the smallest unit, rounded up."""
    return F.ceil(input_units * per_input + output_units * per_output).cast("long")


def usage(ledger: DataFrame) -> DataFrame:
    """Per scenario: calls, calls of unknown cost, known cost, and exposure with unknown ones at their reservation."""
    known = F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2)
    return ledger.groupBy("scenario").agg(
        F.count("*").alias("calls"), F.count_if(F.col("cost").isNull()).alias("unknown"), known.alias("known_cost"), F.round(F.sum(F.coalesce("cost", "reservation")), 2).alias("exposure")
    )


def savings(ledger: DataFrame, reference: DataFrame) -> DataFrame:
    """Cost and calls avoided against the one scenario that ``reference`` names.

    percent is null when the reference cost nothing; everything of cost is null
    when a call's cost is unknown.
    """
    cost = F.when(F.count_if(F.col("cost").isNull()) == 0, F.sum("cost"))
    totals = ledger.groupBy("scenario").agg(cost.alias("total"), F.count("*").alias("calls"))
    base = totals.join(F.broadcast(reference), "scenario", "left_semi")
    both = totals.withColumn("reference", base.select(F.struct("total", "calls")).scalar()).withColumns({"base": F.col("reference.total"), "base_calls": F.col("reference.calls")})
    gain = F.col("base") - F.col("total")
    percent = F.when(F.col("base") != 0, gain * F.lit(100.0) / F.col("base"))
    return both.select("scenario", F.round(gain, 2).alias("avoided"), F.round(percent, 4).alias("percent"), (F.col("base_calls") - F.col("calls")).alias("calls_avoided"))
