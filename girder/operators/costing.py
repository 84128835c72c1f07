"""Money: bills, build-ups, landed cost, labour and price history, in decimals and rounded line by line."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.lookup import as_of

MONEY = "decimal(14,2)"
FINE = "decimal(18,4)"
#: Totals over any number of lines.
TOTAL = "decimal(38,2)"


def money(c: Column) -> Column:
    """Half-up to the cent."""
    return F.round(c, 2).cast(MONEY)


def section_totals(lines: DataFrame, section: str, amount: str) -> DataFrame:
    """Total, priced and unpriced lines of each section and of all (section null), in one pass."""
    sums = lines.rollup(section).agg(F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL).alias("total"), F.count(amount).alias("priced"), F.count_if(F.col(amount).isNull()).alias("unpriced"), F.grouping(section).alias("is_total"))
    return sums.withColumn("is_total", F.col("is_total") == 1)


#: The steps of a build-up: component, and the base that its percentage is of.
STEPS = (
    ("site_overheads", "direct"), ("preliminaries", "direct"), ("insurance", "direct"), ("bonds", "direct"),
    ("contingency", "cost"), ("margin", "cost_with_contingency"),
)


def build_up(direct: DataFrame, percents: dict[str, str]) -> DataFrame:
    """direct (a column direct beside a bid's keys) with every component, cost, cost with contingency and price."""
    out = direct.withColumn("direct", F.col("direct").cast(MONEY))

    def part(name: str, base: str) -> Column:
        return money(F.col(base) * F.lit(Decimal(percents.get(name, "0"))).cast("decimal(6,3)") / 100)

    indirect = [n for n, base in STEPS if base == "direct"]
    out = out.withColumns({n: part(n, "direct") for n in indirect})
    out = out.withColumn("cost", (F.col("direct") + sum((F.col(n) for n in indirect), F.lit(Decimal("0.00")))).cast(MONEY))
    out = out.withColumn("contingency", part("contingency", "cost")).withColumn("cost_with_contingency", (F.col("cost") + F.col("contingency")).cast(MONEY))
    return out.withColumn("margin", part("margin", "cost_with_contingency")).withColumn("price", (F.col("cost_with_contingency") + F.col("margin")).cast(MONEY))


def with_tax(totals: DataFrame, rates: DataFrame, keys: list[str], day: str, amount: str, row: list[str]) -> DataFrame:
    """totals with the percent in force on their day, the tax on their amount, half up to the cent, and both together.

    rates: keys, since, percent.  A day before all rates of its key is an error, as a total without tax would go unseen.
    """
    found = as_of(totals, rates, keys, day, "since", row, bucket=lambda c: F.year(c))
    missing = F.raise_error(F.concat(F.lit("no tax rate is in force on "), F.col(day).cast("string")))
    found = found.withColumn("percent", F.when(F.col("percent").isNull(), missing).otherwise(F.col("percent")).cast("decimal(6,3)"))
    found = found.withColumn("tax", money(F.col(amount).cast(MONEY) * F.col("percent") / 100))
    return found.withColumn("inclusive", (F.col(amount).cast(MONEY) + F.col("tax")).cast(MONEY)).drop("since")


def call_costs(calls: DataFrame, prices: DataFrame, keys: list[str], day: str, row: list[str]) -> DataFrame:
    """calls (fresh and cached tokens in `tokens`, of those `cached`, and `output` ones) with cost, by the prices for a
    million tokens that were in force on their day.

    prices: keys, since, per_input, per_output, per_cached (null: as input).  Costs have six places, ties to the even digit;
    a call without a price costs nothing, which is seen where costs are listed.
    """
    found = as_of(calls, prices, keys, day, "since", row, bucket=lambda c: F.year(c))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    fresh = F.greatest(F.col("tokens") - F.col("cached"), F.lit(0)).cast("decimal(18,0)")
    total = fresh * F.col("per_input") + wide("output") * F.col("per_output") + wide("cached") * F.coalesce("per_cached", "per_input")
    cost = (F.bround(total, 0).cast("decimal(24,0)") / 1_000_000).cast("decimal(24,6)")
    return found.select(*calls.columns, F.coalesce(cost, F.lit(0)).cast("decimal(24,6)").alias("cost"))


def landed_unit(price: Column, rate: Column, buffer_percent: str, percents: list[str]) -> Column:
    """A foreign price in own money: exchange and its buffer, each import line as a percentage of that, four places each, two in the end."""
    base = F.round(price * rate, 4).cast(FINE)
    base = (base + F.round(base * F.lit(Decimal(buffer_percent)).cast("decimal(6,3)") / 100, 4)).cast(FINE)
    total = base
    for p in percents:
        total = total + F.round(base * F.lit(Decimal(p)).cast("decimal(6,3)") / 100, 4).cast(FINE)
    return money(total)


def variance(client: Column, measured: Column, limit: str = "5.0") -> tuple[Column, Column, Column]:
    """Difference, percent at one place (null where the client has none), and whether it exceeds the limit either way."""
    gap = measured - client
    percent = F.round(F.try_divide(gap * 100, F.nullif(client, F.lit(0).cast("decimal(14,3)"))), 1).cast("decimal(14,1)")
    over = F.coalesce(F.abs(percent) > F.lit(Decimal(limit)), (measured > 0) & (F.coalesce(client, F.lit(0)) == 0), F.lit(False))
    return gap, percent, over


def price_statistics(history: DataFrame, keys: list[str], price: str, at: str, tie: str) -> DataFrame:
    """n, least, most, exact median and latest of the positive prices of each key."""
    return history.filter(F.col(price) > 0).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(price).alias("least"), F.max(price).alias("most"), F.median(price).cast("decimal(16,4)").alias("median"), F.max_by(price, F.struct(at, tie)).alias("latest")
    )


def labour_lines(lines: DataFrame, hours_per_unit: Column, factors: Column, rate: Column) -> DataFrame:
    """lines (quantity) with factor, hours (two places) and cost; factors is an array of decimals."""
    factor = F.aggregate(factors, F.lit(Decimal("1.0000")).cast(FINE), lambda a, x: F.round(a * x, 4).cast(FINE))
    out = lines.withColumn("factor", factor).withColumn("hours", F.round(F.col("quantity") * hours_per_unit * F.col("factor"), 2).cast(MONEY))
    return out.withColumn("cost", money(F.col("hours") * rate))
