"""Labelled segments and market prices to the edge report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phrasecast.operators import market, rates


def phrase_edges(segments: DataFrame, targets: Sequence[str], markets: DataFrame) -> DataFrame:
    """Base rates with intervals against ``markets(ticker, target, <price fields>)``."""
    priced = market.market_probabilities(markets, keep=["target"])
    prices = priced.select("target", F.col("market_probability").alias("market_prob"))
    return rates.edge_report(rates.rate_intervals(segments, targets), prices)
