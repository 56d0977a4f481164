"""A query for each operator, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as op
from ..panel import ASSET, DATE, FLAG, FRAME, VALUE
from ..sources import panels
from .fixtures import SQL, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, and no negative zero."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def register(name: str, build: Callable[[Fixtures], DataFrame], sql: str | None = None) -> None:
    """sql: a select over the fixtures, or more common tables and, after @@, a select."""
    QUERIES[name] = lambda spark, sf_dir: _rounded(build(Fixtures(spark, sf_dir)))
    if sql is not None:
        more, _, select = sql.rpartition(" @@ ")
        ORACLES[name] = SQL + (", " + more if more else "") + "\n" + select


def cell(value: str, source: str, more: str = "") -> str:
    """Select of date, asset and a rounded value."""
    return f"select date, asset, round({value}, 6) + 0.0 as value from {source} {more}"


def per_date(value: str, source: str) -> str:
    return f"select date, round({value}, 6) + 0.0 as value from {source} group by date"


D, A = "over (partition by date)", "(partition by asset order by date)"


def last(n: int) -> str:
    return f"over (partition by asset order by date rows between {n - 1} preceding and current row)"


def _grid(f: Fixtures) -> DataFrame:
    """Hours from the first event day to two days after the last."""
    ends = f.ev_d.agg(F.min(DATE).cast("timestamp_ntz").alias("a"), (F.max(DATE).cast("timestamp_ntz") + F.expr("interval 2 days")).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias(DATE))


def _text_date(df: DataFrame) -> DataFrame:
    return df.withColumn(DATE, F.date_format(DATE, "yyyy-MM-dd HH:mm:ss"))


# sources and container
register("c_round_trip", lambda f: panels.from_wide(panels.to_wide(f.ord_d)), cell("value", "ord_d"))
register("c_last_row", lambda f: panels.last_row(f.ord_m), "select asset, round(value, 6) + 0.0 as value from ord_m where date = (select max(date) from ord_m)")
register("c_validate", lambda f: panels.validate(f.ord_d), cell("value", "ord_d"))

register(
    "c_equal",
    lambda f: f.spark.createDataFrame([(n, bool(panels.equal_panels(f.ord_d, other))) for n, other in (("itself", panels.from_wide(panels.to_wide(f.ord_d))), ("lagged", op.lag_rows(f.ord_d, 1)), ("shorter", f.ord_d.where("value is not null")))], "other string, equal boolean"),
    f"""lg as (select date, asset, lag(value) over {A} as value from ord_d) @@ select 'itself' as other, true as equal
    union all select 'lagged', not exists (select 1 from ord_d o join lg using (date, asset) where o.value is distinct from lg.value)
    union all select 'shorter', not exists (select 1 from ord_d where value is null)""",
)
register(
    "c_shape",
    lambda f: f.spark.createDataFrame([(n, *panels.shape(p), panels.is_empty(p), panels.has_dates(p)) for n, p in (("ord_d", f.ord_d), ("ord_m", f.ord_m), ("none", f.ord_d.where("false")))], "panel string, dates long, assets long, empty boolean, has_dates boolean"),
    "select 'ord_d' as panel, count(distinct date) as dates, count(distinct asset) as assets, count(*) = 0 as empty, count(date) > 0 as has_dates from ord_d"
    " union all select 'ord_m', count(distinct date), count(distinct asset), count(*) = 0, count(date) > 0 from ord_m union all select 'none', 0, 0, true, false",
)
register("c_with_values", lambda f: panels.with_values(f.ord_d, F.col(VALUE) * 2 - 1), cell("value * 2 - 1", "ord_d"))
ROWS = (("2024-01-05", (1.5, None)), ("2024-01-02", (-2.0, 0.25)), ("2024-01-09", (None, float("inf"))))
register(
    "c_from_rows",
    lambda f: _text_date(panels.from_rows(f.spark, [d for d, _ in ROWS], ["p", "q"], [r for _, r in ROWS])),
    "select * from (values " + ", ".join(f"('{d} 00:00:00', '{a}', {'null' if x is None or x == float('inf') else x}::double)" for d, r in ROWS for a, x in zip("pq", r, strict=True)) + ") t(date, asset, value)",
)
register(
    "stack_count",
    lambda f: op.align(f.frames).select(FRAME).distinct().select(FRAME, F.lit(op.stack_count(f.frames)).cast("long").alias("frames")),
    "select distinct frame, (select count(distinct frame) from stack) as frames from stack",
)

# joining
register("align", lambda f: op.align(f.frames), "select frame, date, asset, round(value, 6) + 0.0 as value from stack")
CARRIED = """h as (select unnest(generate_series(min(date)::timestamp, max(date)::timestamp + interval 2 days, interval 1 hour)) as date from ev_d),
s as (select distinct date::timestamp as src from ev_d), n as (select h.date, s.src from h asof left join s on h.date >= s.src)"""
for _name, _age in (("carried", None), ("carried_max_age", 30)):
    register(
        _name,
        lambda f, age=_age: _text_date(op.carried(f.ev_d.withColumn(DATE, F.col(DATE).cast("timestamp_ntz")), _grid(f), max_age=timedelta(hours=age) if age else None)),
        f"{CARRIED}, m as (select date, {'case when date - src <= interval 30 hours then src end' if _age else 'src'} as src from n) @@ "
        "select strftime(m.date, '%Y-%m-%d %H:%M:%S') as date, a.asset, round(e.value, 6) + 0.0 as value from m cross join (select distinct asset from ev_d) a left join ev_d e on e.date::timestamp = m.src and e.asset = a.asset",
    )

# across frames
SHARES = {"F": 0.5, "O": 0.3, "P": 0.2}
SHARES_SQL = "sh(frame, share) as (values ('F', 0.5::double), ('O', 0.3::double), ('P', 0.2::double)), st as (select * from stack join sh using (frame))"


def _daily_shares(f: Fixtures) -> DataFrame:
    day = f.stack.select(FRAME, DATE).distinct()
    return day.select(FRAME, DATE, (F.dayofmonth(DATE).cast("double") + F.when(F.col(FRAME) == "F", 2.0).when(F.col(FRAME) == "O", 1.0).otherwise(0.0)).alias("share"))


DAILY_SQL = "st as (select *, day(date)::double + case frame when 'F' then 2.0 when 'O' then 1.0 else 0.0 end as share from stack)"
WEIGHTED = "sum(value * share) / nullif(sum(case when value is not null then share end), 0)"


def across(value: str, source: str = "stack") -> str:
    return f"select date, asset, round({value}, 6) + 0.0 as value from {source} group by date, asset"


register("nanmean_stack", lambda f: op.nanmean_stack(f.stack), across("avg(value)"))
register("nanmedian_stack", lambda f: op.nanmedian_stack(f.stack), across("median(value)"))
register("weighted_nanmean_stack", lambda f: op.weighted_nanmean_stack(f.stack, SHARES), f"{SHARES_SQL} @@ " + across(WEIGHTED, "st"))
register("mean_stack", lambda f: op.mean_stack(f.stack), across("avg(coalesce(value, 0))"))
register("weighted_mean_stack", lambda f: op.weighted_mean_stack(f.stack, SHARES), f"{SHARES_SQL} @@ " + across("sum(coalesce(value, 0) * share) / nullif(sum(share), 0)", "st"))
register("weighted_nanmean_stack_over_time", lambda f: op.weighted_nanmean_stack_over_time(f.stack, _daily_shares(f)), f"{DAILY_SQL} @@ " + across(WEIGHTED, "st"))
register(
    "mean_stack_over_time",
    lambda f: op.mean_stack_over_time(f.stack, _daily_shares(f)),
    f"{DAILY_SQL}, sp as (select *, case when count(value) over (partition by frame, date) > 0 then share else 0.0 end as used from st) @@ " + across("sum(coalesce(value, 0) * used) / nullif(sum(used), 0)", "sp"),
)
register(
    "normalised_shares",
    lambda f: op.normalised_shares(f.stack.groupBy(FRAME).agg((F.avg(VALUE) - 1.2).alias(VALUE))),
    "sc as (select frame, avg(value) - 1.2 as value from stack group by frame), po as (select frame, case when value > 0 then value else 0 end as p from sc) @@ "
    "select frame, round(case when sum(p) over () > 0 then p / sum(p) over () else 1.0 / count(*) over () end, 6) + 0.0 as share from po",
)
register("stack_volatility", lambda f: op.stack_volatility(f.stack), "select frame, round(stddev_samp(value), 6) + 0.0 as value from stack group by frame")
register("stack_volatility_ddof2", lambda f: op.stack_volatility(f.stack, ddof=2), "select frame, round(sqrt(var_pop(value) * count(value) / (count(value) - 2)), 6) + 0.0 as value from stack group by frame")

# sizing
register("row_sums", lambda f: op.row_sums(f.ord_d), per_date("coalesce(sum(value), 0)", "ord_d"))
register("held", lambda f: op.held(f.ord_d), "select date, asset, coalesce(value <> 0, false) as flag from ord_d")
register("fill_missing", lambda f: op.fill_missing(f.ord_d, op.lag_rows(f.ord_d, 1)), cell(f"coalesce(value, lag(value) over {A})", "ord_d"))
register("normalised_share", lambda f: op.normalised_share(f.ord_d, op.held(f.ord_d), power=-1.0), cell(f"coalesce((1 / value) / sum(1 / value) {D}, 0) * count(value) {D}", "ord_d"))
register("rescaled_to_held_count", lambda f: op.rescaled_to_held_count(f.ord_d), cell(f"value / nullif(sum(value) {D}, 0) * count(value) {D}", "ord_d"))
register("gross", lambda f: op.gross(f.book), per_date("coalesce(sum(abs(value)), 0)", "book"))
register("to_gross", lambda f: op.to_gross(f.book, 1.0), cell(f"case when sum(abs(value)) {D} > 0 then value / sum(abs(value)) {D} else value end", "book"))
register("net", lambda f: op.net(f.ord_d), per_date("coalesce(sum(value), 0)", "ord_d"))
SCALE = "least(1.0, case when g > 0 then 5.0 / g else 1.0 end, case when abs(n) > 0 then 2.0 / abs(n) else 1.0 end)"
register("exposure_scale", lambda f: op.exposure_scale(f.ord_d, max_gross=5.0, max_net=2.0), f"x as (select date, coalesce(sum(abs(value)), 0) as g, coalesce(sum(value), 0) as n from ord_d group by date) @@ select date, round({SCALE}, 6) + 0.0 as value from x")
register("capped", lambda f: op.capped(f.ord_d, max_gross=5.0, max_net=2.0), f"x as (select *, sum(abs(value)) {D} as g, sum(value) {D} as n from ord_d) @@ " + cell(f"value * {SCALE}", "x"))
register("center", lambda f: op.center(f.ord_d), cell(f"value - avg(value) {D}", "ord_d"))
register("clip_allocation", lambda f: op.clip_allocation(f.book, 0.05), cell("case when value is not null then greatest(least(value, 0.05), -0.05) end", "book"))
register("quantize", lambda f: op.quantize(f.ord_d, 0.25), cell("round_even(value / 0.25, 0) * 0.25", "ord_d"))
register("tilt", lambda f: op.tilt(f.ord_d, 0.1), cell(f"case when value <> 0 then value + 0.1 / count(case when value <> 0 then 1 end) {D} else value end", "ord_d"))
register(
    "weights_from_bins",
    lambda f: op.weights_from_bins(op.quantize(f.ord_d, 1.0)),
    f"""b as (select date, asset, round_even(value, 0) as value from ord_d), x as (select *, min(value) {D} as lo, max(value) {D} as hi from b),
    y as (select date, asset, case when value is not null then case when hi > lo then (value - lo) / (hi - lo) * 2 - 1 else 0 end end as value from x) @@ """
    + cell(f"case when value is not null then coalesce(value / nullif(sum(abs(value)) {D}, 0), 0) end", "y"),
)

# cross-section
register("row_counts", lambda f: op.row_counts(f.ord_d), "select date, count(value)::double as value from ord_d group by date")
register("row_means", lambda f: op.row_means(f.ord_d), per_date("avg(value)", "ord_d"))
for _ddof, _kind in ((0, "pop"), (1, "samp")):
    register(
        f"standardize_rows_ddof{_ddof}",
        lambda f, ddof=_ddof: op.standardize_rows(f.ord_d, ddof),
        cell(f"case when value is not null and count(value) {D} > {_ddof} then case when max(value) {D} = min(value) {D} then 0 else (value - avg(value) {D}) / stddev_{_kind}(value) {D} end end", "ord_d"),
    )
register("row_rank_pct", lambda f: op.row_rank_pct(f.ord_d), cell(f"case when value is not null then row_number() over (partition by date, value is null order by value, asset) / (count(value) {D})::double end", "ord_d"))
register(
    "row_rank_minmax",
    lambda f: op.row_rank_minmax(op.quantize(f.ord_d, 0.5)),
    f"""q as (select date, asset, round_even(value / 0.5, 0) * 0.5 as value from ord_d),
    x as (select *, rank() over (partition by date, value is null order by value) as r, count(value) over (partition by date, value) as e, count(value) {D} as n from q) @@ """
    + cell("case when value is not null and n > 1 then (r + (e - 1) / 2.0::double - 1) / (n - 1) end", "x"),
)
register("top_n_mask", lambda f: op.top_n_mask(f.ord_d, 2), "select date, asset, value is not null and row_number() over (partition by date order by value desc nulls last, asset) <= 2 as flag from ord_d")


def _controls(f: Fixtures) -> DataFrame:
    one = op.lag_rows(f.ord_m, 1).withColumnRenamed(VALUE, "c1")
    two = op.lag_rows(f.ord_m, 2).withColumnRenamed(VALUE, "c2")
    return f.ord_m.join(one, [DATE, ASSET]).join(two, [DATE, ASSET])


CONTROLS = f"c0 as (select date, asset, value as y, lag(value, 1) over {A} as c1, lag(value, 2) over {A} as c2 from ord_m)"
TWO = f"""{CONTROLS}, c3 as (select *, y is not null and c1 is not null and c2 is not null as ok from c0),
c4 as (select date, asset, y - avg(y) {D} as y, c1 - avg(c1) {D} as c1, c2 - avg(c2) {D} as c2 from c3 where ok),
c5 as (select date, asset, y, c1, c2 - coalesce(sum(c1 * c2) {D} / nullif(sum(c1 * c1) {D}, 0), 0) * c1 as c2 from c4),
c6 as (select date, asset, c1, c2, y - coalesce(sum(y * c1) {D} / nullif(sum(c1 * c1) {D}, 0), 0) * c1 as y from c5),
c7 as (select date, asset, y - coalesce(sum(y * c2) {D} / nullif(case when sum(c2 * c2) {D} > 1e-24 then sum(c2 * c2) {D} end, 0), 0) * c2 as y from c6)"""
register("project_out_rows", lambda f: op.project_out_rows(_controls(f), ["c1", "c2"]), f"{TWO} @@ select m.date, m.asset, round(y, 6) + 0.0 as value from ord_m m left join c7 using (date, asset)")
ONE = f"""{CONTROLS}, c4 as (select date, asset, y - avg(y) {D} as y, c1 - avg(c1) {D} as c1 from c0 where y is not null and c1 is not null),
c5 as (select date, asset, y - coalesce(sum(y * c1) {D} / nullif(case when sum(c1 * c1) {D} > 1e-24 then sum(c1 * c1) {D} end, 0), 0) * c1 as y from c4),
c6 as (select date, asset, case when max(y) {D} = min(y) {D} then 0 else y / nullif(stddev_pop(y) {D}, 0) end as y, count(*) {D} as n from c5)"""
register("residualize_rows", lambda f: op.residualize_rows(_controls(f), ["c1"], required_assets=4), f"{ONE} @@ select m.date, m.asset, round(y, 6) + 0.0 as value from ord_m m left join (select * from c6 where n >= 4) using (date, asset)")

# rolling
ROW = f"row_number() over {A}"
register(
    "windowed",
    lambda f: op.windowed(f.ev_d, 3),
    f"w as (select date, asset, [lag(value, 2) over {A}, lag(value, 1) over {A}, value] as v from ev_d) @@ select date, asset, (i - 1)::int as slot, round(v[i], 6) + 0.0 as value from w, (select unnest([1, 2, 3]) as i)",
)
register("partial_rolling_mean", lambda f: op.partial_rolling_mean(f.ord_d, 10, 3), cell(f"case when count(value) {last(10)} >= 3 then avg(value) {last(10)} end", "ord_d"))
register("partial_rolling_std", lambda f: op.partial_rolling_std(f.ord_d, 10, 3), cell(f"case when count(value) {last(10)} >= 3 then nullif(stddev_samp(value) {last(10)}, 0) end", "ord_d"))
for _low, _agg in ((True, "min"), (False, "max")):
    register(f"rolling_extreme_{_agg}", lambda f, low=_low: op.rolling_extreme(f.ord_d, 10, 3, lowest=low), cell(f"case when count(value) {last(10)} >= 3 then {_agg}(value) {last(10)} end", "ord_d"))
    register(
        f"bars_since_extreme_{_agg}",
        lambda f, low=_low: op.bars_since_extreme(op.quantize(f.ord_d, 1.0), 10, 3, lowest=low),
        f"q as (select date, asset, round_even(value, 0) as value, {ROW} as r from ord_d) @@ " + cell(f"case when count(value) {last(10)} >= 3 then (r - arg_{_agg}(r, value) {last(10)})::double end", "q"),
    )
register(
    "rolling_correlation",
    lambda f: op.rolling_correlation(f.ord_m, op.lag_rows(f.ord_m, 1), 12, 4),
    f"""b as (select date, asset, value as x, lag(value) over {A} as y from ord_m), c as (select date, asset, case when y is not null then x end as x, case when x is not null then y end as y from b) @@ """
    + cell(f"case when count(x) {last(12)} >= 4 then covar_pop(x, y) {last(12)} / nullif(stddev_pop(x) {last(12)} * stddev_pop(y) {last(12)}, 0) end", "c"),
)
register("rolling_correlation_series", lambda f: op.rolling_correlation(f.ret, f.market, 12, 4), "b as (select r.date, r.asset, r.value as p, m.value as q from ret r join market m using (date)), c as (select date, asset, case when q is not null then p end as x, case when p is not null then q end as y from b) @@ " + cell(f"case when count(x) {last(12)} >= 4 then covar_pop(x, y) {last(12)} / nullif(stddev_pop(x) {last(12)} * stddev_pop(y) {last(12)}, 0) end", "c"))
register("rolling_slope", lambda f: op.rolling_slope(f.ord_d, 10, 3), f"q as (select *, ({ROW})::double as r from ord_d) @@ " + cell(f"case when count(value) {last(10)} >= 3 then regr_slope(value, r) {last(10)} end", "q"))

# smoothing
register("rolling_mean", lambda f: op.rolling_mean(f.ev_d, 5), cell(f"case when count(value) {last(5)} = 5 then avg(value) {last(5)} end", "ev_d"))
register(
    "ewm_mean",
    lambda f: op.ewm_mean(f.ord_m, 5),
    f"""q as (select date, asset, value, {ROW} as r from ord_m),
    p as (select a.date, a.asset, sum(b.value * pow(1 - 2.0 / 6, a.r - b.r)) / sum(pow(1 - 2.0 / 6, a.r - b.r)) as value, count(*) as n from q a join q b on a.asset = b.asset and b.r <= a.r and b.value is not null group by 1, 2) @@ select q.date, q.asset, round(case when n >= 5 then p.value end, 6) + 0.0 as value from q left join p using (date, asset)""",
)
register("lag_rows", lambda f: op.lag_rows(f.ord_d, 3), cell(f"lag(value, 3) over {A}", "ord_d"))

# risk
register("rolling_sums", lambda f: op.rolling_sums(f.ev_d, 4), cell(f"case when count(value) {last(4)} = 4 then sum(value) {last(4)} end", "ev_d"))
register("trailing_std", lambda f: op.trailing_std(f.ord_m, 6), f"q as (select *, {ROW} as r from ord_m) @@ " + cell(f"case when r >= 6 and count(value) {last(6)} >= 2 then stddev_samp(value) {last(6)} end", "q"))
register(
    "downside_deviation",
    lambda f: op.downside_deviation(f.ret, 6),
    f"q as (select *, {ROW} as r from ret) @@ " + cell(f"case when r >= 6 then sqrt(sum(case when value < 0 then value * value end) {last(6)} / nullif(count(case when value < 0 then 1 end) {last(6)}, 0)) end", "q"),
)
register(
    "inverse_volatility_share",
    lambda f: op.inverse_volatility_share(op.partial_rolling_std(f.ord_m, 12, 3), f.ord_m),
    f"""s as (select date, asset, value as side, case when count(value) {last(12)} >= 3 then nullif(stddev_samp(value) {last(12)}, 0) end as s0 from ord_m),
    s1 as (select date, asset, side, case when side is not null then s0 end as s from s), s2 as (select *, sum(s) {D} / s as inv from s1) @@ """
    + cell(f"inv / sum(inv) {D} * count(side) {D}", "s2"),
)
COV = """ax as (select distinct asset from ret), pr as (select a.asset as asset_i, b.asset as asset_j, covar_samp(a.value, b.value) as c, count(*) as n
  from ret a join ret b on a.date = b.date and a.value is not null and b.value is not null group by 1, 2),
cv as (select i.asset as asset_i, j.asset as asset_j, coalesce(case when n > 1 then c end, 0) as cov from ax i cross join ax j left join pr on asset_i = i.asset and asset_j = j.asset)"""
register("observed_covariance", lambda f: op.observed_covariance(f.ret), f"{COV} @@ select asset_i, asset_j, round(cov, 6) + 0.0 as cov from cv")


def _coverage(f: Fixtures) -> DataFrame:
    return f.ret.groupBy(ASSET).agg((F.count(VALUE) / F.count("*")).cast("double").alias(VALUE))


register(
    "penalised_for_coverage",
    lambda f: op.penalised_for_coverage(op.observed_covariance(f.ret), _coverage(f)),
    f"""{COV}, cg as (select asset, count(value)::double / count(*) as cover from ret group by asset), va as (select asset_i as asset, cov as var from cv where asset_i = asset_j),
    nw as (select asset, sqrt(var) as sd, sqrt(cover * var + (1 - cover) * max(var) over ()) as new, min(cover) over () as least, max(var) over () as worst from va join cg using (asset)) @@ select asset_i, asset_j, round(case when i.least >= 1 or i.worst <= 0 then cov when asset_i = asset_j then i.new * j.new else coalesce(cov / nullif(i.sd * j.sd, 0), 0) * i.new * j.new end, 6) + 0.0 as cov
    from cv join nw i on i.asset = asset_i join nw j on j.asset = asset_j""",
)


def equal_risk_sql(period: int, at: str) -> str:
    """Common tables up to sz (at, asset, size): what each row at holds, sized from its trailing rows by 50 steps, correlations halved."""
    return f"""erd as (select date, row_number() over (order by date) - 1 as r from (select distinct date from ret)),
    erx as (select r, date, asset, value, coalesce(value <> 0, false) as h from ret join erd using (date)),
    era as (select r as reb from erd where {at}),
    ern as (select reb, asset from era join erx on r = reb where h),
    erw as (select reb, r, asset, value from era join erx on r between reb - {period - 1} and reb join ern using (reb, asset)),
    ert as (select reb, count(distinct asset) as n, count(distinct r) as n_rows from erw group by reb),
    erc as (select reb, asset, count(value)::double / count(*) as cover from erw group by reb, asset),
    erp as (select a.reb, a.asset as i, b.asset as j, covar_samp(a.value, b.value) as c, count(*) as n from erw a join erw b on a.reb = b.reb and a.r = b.r and a.value is not null and b.value is not null group by 1, 2, 3),
    erv as (select x.reb, x.asset as i, y.asset as j, coalesce(case when n > 1 then c end, 0) as c from ern x join ern y on x.reb = y.reb left join erp p on p.reb = x.reb and p.i = x.asset and p.j = y.asset),
    ero as (select reb, i as asset, c as var, cover, max(c) over (partition by reb) as worst, min(cover) over (partition by reb) as thinnest from erv join erc using (reb) where i = j and erc.asset = i),
    ers as (select *, case when thinnest < 1 and worst > 0 then cover * var + (1 - cover) * worst else var end as own from ero),
    erm as (select v.reb, v.i, v.j, case when v.i = v.j then a.own else 0.5 * coalesce(v.c / nullif(sqrt(a.var * b.var), 0), 0) * sqrt(a.own * b.own) end as c from erv v join ers a on a.reb = v.reb and a.asset = v.i join ers b on b.reb = v.reb and b.asset = v.j),
    erl as (select reb, list(line order by i) as c, 1e-6 * greatest(avg(own), 1e-18) as floor from (select reb, i, list(c order by j) as line, max(case when i = j then c end) as own from erm group by reb, i) group by reb),
    erk(reb, k, w) as (
      select reb, 0, list_transform(range(n), lambda x: 1.0::double / n) from ert where n > 1 and n_rows >= 3 union all
      select reb, k + 1, case when risk > 0 then list_transform(moved, lambda x: x / list_sum(moved)) else w end from (
        select *, list_transform(range(1, len(w) + 1), lambda i: sqrt(w[i] * greatest(risk, 0) / (len(w) * greatest(m[i], floor)))) as moved from (
          select *, list_dot_product(w, m) as risk from (select reb, k, w, floor, list_transform(c, lambda line: list_dot_product(line, w)) as m from erk join erl using (reb) where k < 50)))),
    sz as (select reb, asset, coalesce(w[nth], 1.0) as size from (select reb, asset, row_number() over (partition by reb order by asset) as nth from ern) left join (select reb, w from erk where k = 50) using (reb))"""


def _recursive(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("with ord_c", "with recursive ord_c", 1)


def _last_rows(f: Fixtures, n: int) -> DataFrame:
    days = f.ret.select(DATE).distinct().orderBy(F.desc(DATE)).limit(n)
    return f.ret.join(F.broadcast(days), DATE)


def _last_held(f: Fixtures) -> DataFrame:
    return op.held(_last_rows(f, 1)).select(ASSET, FLAG)


register(
    "equal_risk_row",
    lambda f: op.equal_risk_sizes(_last_rows(f, 24), _last_held(f)),
    equal_risk_sql(24, "r = (select max(r) from erd)") + " @@ select distinct ret.asset, round(coalesce(size, 0), 6) + 0.0 as value from ret left join sz using (asset)",
)
register(
    "equal_risk_weights",
    lambda f: op.equal_risk_weights(f.ret, op.held(f.ret), op.EqualRiskConfig(period=12, rebalance=3)),
    equal_risk_sql(12, "r % 3 = 0")
    + f", erz as (select date, x.asset, h, case when h then coalesce(size, 0) else 0 end as size from erx x left join sz on sz.reb = x.r - x.r % 3 and sz.asset = x.asset) @@ "
    + cell(f"coalesce(size / nullif(sum(size) {D}, 0), 0) * sum(h::int) {D}", "erz"),
)
_recursive("equal_risk_row")
_recursive("equal_risk_weights")
register(
    "volatility_target",
    lambda f: op.volatility_target(f.series, op.VolatilityTargetConfig(period=6, target=0.1, periods_per_year=12)),
    """q as (select date, row_number() over w as r, count(value) over t as n, stddev_samp(value) over t * sqrt(12) as s from series window w as (order by date), t as (order by date rows between 5 preceding and current row)) @@ select date, round(greatest(least(coalesce(case when r >= 6 and n >= 2 and s > 0 then 0.1 / s end, 1), 3.0), 0), 6) + 0.0 as value from q""",
)

# costs, band, drift
X = "coalesce(value, 0)"
TURN = f"abs({X} - coalesce(lag({X}) over {A}, {X}))"
register("turnover", lambda f: op.turnover(f.book), cell(TURN, "book"))
register("lagged", lambda f: op.lagged(f.book, 1), cell(f"lag(value, 2) over {A}", "book"))
EARN = f"wr as (select b.date, b.asset, coalesce(lag(b.value, 2) over (partition by b.asset order by b.date) * r.value, 0) - 0.001 * abs(coalesce(b.value, 0) - coalesce(lag(coalesce(b.value, 0)) over (partition by b.asset order by b.date), coalesce(b.value, 0))) as value from book b join ret r using (date, asset))"
register("apply_costs", lambda f: op.apply_costs(f.book, f.ret, cost=0.001, lag=1), f"{EARN} @@ " + cell("value", "wr"))
register("book_returns", lambda f: op.book_returns(f.book, f.ret, cost=0.001, lag=1), f"{EARN} @@ " + per_date("sum(value)", "wr"))
register(
    "no_trade_band",
    lambda f: op.no_trade_band(f.ord_m, 0.5),
    f"""recursive_q as (select date, asset, value, 0.5 * avg(abs(value)) {D} as lim, {ROW} as r from ord_m),
    rec as (select date, asset, r, value as h from recursive_q where r = 1 union all
      select q.date, q.asset, q.r, case when not coalesce(q.lim > 0, false) or q.value is null or p.h is null or abs(q.value - p.h) > q.lim then q.value else p.h end
      from rec p join recursive_q q on q.asset = p.asset and q.r = p.r + 1) @@ """
    + cell("h", "rec"),
)
_recursive("no_trade_band")


def _drift(f: Fixtures) -> DataFrame:
    prices = f.ord_m
    weights = op.to_gross(op.clip_allocation(f.book, 0.05), 1.0)
    weights = weights.withColumn(VALUE, F.coalesce(VALUE, F.lit(0.0)))
    return op.drifted_weights(weights, op.lag_rows(prices, 1), prices)


register(
    "drifted_weights",
    _drift,
    f"""k as (select date, asset, case when value is not null then greatest(least(value, 0.05), -0.05) end as value from book),
    w as (select date, asset, coalesce(case when sum(abs(value)) {D} > 0 then value / sum(abs(value)) {D} else value end, 0) as w from k),
    pp as (select date, asset, lag(value) over {A} as p, value as q from ord_m),
    z as (select date, asset, w, w = 0 or coalesce(p > 0 and q > 0, false) as ok, case when w = 0 then 1.0 else q / nullif(p, 0) end as rel from w join pp using (date, asset)),
    y as (select *, bool_and(ok) {D} as good, 1 + sum(w * (rel - 1)) {D} as nav from z) @@ """
    + cell("case when good and nav > 0 then w * rel / nav end", "y"),
)

# metrics
register("compounded", lambda f: op.compounded(f.series), "select round(coalesce(product(1 + value), 1) - 1, 6) + 0.0 as value from series")
register("to_prices", lambda f: op.to_prices(f.series, 100.0), "select date, round(case when value is not null then 100 * product(1 + value) over (order by date) end, 6) + 0.0 as value from series")
register("cagr", lambda f: op.cagr(f.series, 2400), "select round(pow(abs(coalesce(product(1 + value), 1)), 365.0 / 2400) - 1, 6) + 0.0 as value from series")
register("sharpe", lambda f: op.sharpe(f.series, 12), "select round(coalesce(avg(value) / nullif(stddev_samp(value), 0) * sqrt(12), -10), 6) + 0.0 as value from series")
register("beta", lambda f: op.beta(f.series, f.market), "select round(regr_slope(s.value, m.value), 6) + 0.0 as value from series s join market m using (date)")
DRAW = "pz as (select date, case when value is not null then product(1 + value) over (order by date) end as p from series), dd as (select date, p / max(p) over (order by date) - 1 as value from pz)"
register("drawdown", lambda f: op.drawdown(f.series), f"{DRAW} @@ select date, round(value, 6) + 0.0 as value from dd")
register("max_drawdown", lambda f: op.max_drawdown(f.series), f"{DRAW} @@ select round(coalesce(min(value), 0), 6) + 0.0 as value from dd")
