"""Panels made from the sample tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align
from ..panel import ASSET, DATE, VALUE
from ..sources.panels import densify, sanitize


def total(column: str) -> Column:
    """Sum of column that is the same whatever order its rows come in, so that a panel computed twice equals itself.

    Values of up to ten digits and 18 decimals are added exactly and rounded once;
    where a group has others, NaN and infinities too, it is the plain sum.
    """
    exact = F.col(column).try_cast("decimal(28,18)")
    fits = F.col(column).isNull() | F.coalesce(exact.cast("double") == F.col(column), F.lit(False))
    return F.coalesce(F.when(F.bool_and(fits), F.try_sum(exact).cast("double")), F.sum(column))


class Fixtures:
    """Lazily planned panels of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _orders(self, where=None) -> DataFrame:
        o = self.table("orders")
        o = o if where is None else o.where(where)
        return o.groupBy(F.col("o_orderdate").cast("date").alias(DATE), F.col("o_orderpriority").alias(ASSET)).agg((total("o_totalprice") / F.lit(97531.0)).alias(VALUE))

    @property
    def ord_d(self) -> DataFrame:
        """Days by priority: many gaps."""
        return sanitize(densify(self._orders()))

    @property
    def ord_m(self) -> DataFrame:
        """Months by nation: a wide cross-section."""
        o = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        cells = o.groupBy(F.trunc("o_orderdate", "month").alias(DATE), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias(ASSET)).agg((F.sum("o_totalprice") / F.lit(975310.0)).alias(VALUE))
        return sanitize(densify(cells))

    @property
    def ev_d(self) -> DataFrame:
        """Days by event type: no gaps."""
        cells = self.table("events").groupBy(F.col("ts").cast("date").alias(DATE), F.col("event_type").alias(ASSET)).agg((F.sum("value") / F.lit(9753.1)).alias(VALUE))
        return sanitize(densify(cells))

    @property
    def frames(self) -> dict[str, DataFrame]:
        return {s: self._orders(F.col("o_orderstatus") == s) for s in ("F", "O", "P")}

    @property
    def stack(self) -> DataFrame:
        return align(self.frames)

    @property
    def ret(self) -> DataFrame:
        """Changes of ord_m by the month before, scaled down."""
        before = F.lag(VALUE).over(Window.partitionBy(ASSET).orderBy(DATE))
        return self.ord_m.select(DATE, ASSET, ((F.try_divide(F.col(VALUE), before) - 1.0) / 50.0).alias(VALUE))

    @property
    def series(self) -> DataFrame:
        """Mean change of each month."""
        return self.ret.groupBy(DATE).agg(F.avg(VALUE).alias(VALUE))

    @property
    def market(self) -> DataFrame:
        """Change of the month's total."""
        total = self.ord_m.groupBy(DATE).agg(F.sum(VALUE).alias(VALUE))
        before = F.lag(VALUE).over(Window.orderBy(DATE))
        return total.select(DATE, ((F.try_divide(F.col(VALUE), before) - 1.0) / 50.0).alias(VALUE))

    @property
    def book(self) -> DataFrame:
        """ord_m around each month's mean, a signed book."""
        return self.ord_m.select(DATE, ASSET, (F.col(VALUE) - F.avg(VALUE).over(Window.partitionBy(DATE))).alias(VALUE))


SQL = """
with ord_c as (select cast(o_orderdate as date) as date, o_orderpriority as asset, sum(o_totalprice) / 97531.0 as value from orders group by 1, 2),
ord_d as (select date, asset, value from (select distinct date from ord_c) cross join (select distinct asset from ord_c) left join ord_c using (date, asset)),
mon_c as (select cast(date_trunc('month', o_orderdate) as date) as date, lpad(cast(c_nationkey as varchar), 2, '0') as asset, sum(o_totalprice) / 975310.0 as value from orders join customer on o_custkey = c_custkey group by 1, 2),
ord_m as (select date, asset, value from (select distinct date from mon_c) cross join (select distinct asset from mon_c) left join mon_c using (date, asset)),
ev_c as (select cast(ts as date) as date, event_type as asset, sum(value) / 9753.1 as value from events group by 1, 2),
ev_d as (select date, asset, value from (select distinct date from ev_c) cross join (select distinct asset from ev_c) left join ev_c using (date, asset)),
fr_c as (select o_orderstatus as frame, cast(o_orderdate as date) as date, o_orderpriority as asset, sum(o_totalprice) / 97531.0 as value from orders group by 1, 2, 3),
stack as (select frame, date, asset, value from (select distinct frame from fr_c) cross join (select distinct date from fr_c) cross join (select distinct asset from fr_c) left join fr_c using (frame, date, asset)),
ret as (select date, asset, (value / nullif(lag(value) over (partition by asset order by date), 0) - 1.0) / 50.0 as value from ord_m),
series as (select date, avg(value) as value from ret group by date),
mkt_t as (select date, sum(value) as value from ord_m group by date),
market as (select date, (value / nullif(lag(value) over (order by date), 0) - 1.0) / 50.0 as value from mkt_t),
book as (select date, asset, value - avg(value) over (partition by date) as value from ord_m)
"""
