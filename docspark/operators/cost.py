"""Token and money accounting."""

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prices:
    """USD per million tokens in and out, and tomans per USD."""

    input_usd: float = 2.5
    output_usd: float = 10.0
    toman: int = 230_000


def _each(price: float) -> Column:
    """The price of one token, exactly."""
    return F.lit(Decimal(str(price)).scaleb(-6))


def money(tokens: Column, answer: Column, prices: Prices = Prices()) -> dict[str, Column]:
    """Costs in USD to 4 places, halves up, and in whole tomans; added up in decimals, so that halves are halves."""
    usd_in, usd_out = tokens * _each(prices.input_usd), answer * _each(prices.output_usd)
    costs = {"input_cost_usd": usd_in, "output_cost_usd": usd_out, "total_cost_usd": usd_in + usd_out}
    toman = F.rint((usd_in + usd_out).cast("double") * prices.toman).cast("long")
    return {name: F.round(usd, 4).cast("double") for name, usd in costs.items()} | {"total_cost_toman": toman}


def scenario(rows: DataFrame, context: Column, question: Column, answer: Column, prices: Prices = Prices()) -> DataFrame:
    """Adds input_tokens, total_tokens and costs."""
    rows = rows.withColumn("input_tokens", context + question).withColumn("total_tokens", context + question + answer)
    return rows.withColumns(money(F.col("input_tokens"), answer, prices))
