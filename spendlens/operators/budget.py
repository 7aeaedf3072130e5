"""Budget operators: spend consistency (A27) and budget reallocation (A29)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.columns import guarded_ratio
from spendlens.functions.exact import average, exact_sum, total
from spendlens.functions.joins import join_on
from spendlens.functions.shared import shared
from spendlens.functions.stats import digits_of, population_stddev
from spendlens.operators.attribution import _attributed_sql, exact_type, _partition, _q, is_long
from spendlens.operators.blocks import BLOCK, HALO, in_blocks, with_history
from spendlens.operators.ranking import rank_bounds, with_facts
from spendlens.sources.schemas import CHANNELS, SPEND_SUFFIX


def spend_consistency(spend_long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(channel, mean_spend, stddev_spend, cv_spend, min_spend, max_spend, range_spend),
    most stable (lowest CV, a plain ratio) first."""
    g = spend_long.groupBy(*keys, "channel").agg(
        average(spend_long, "spend").alias("mean_spend"),
        population_stddev("spend", digits_of(spend_long, "spend")).alias("stddev_spend"),
        F.min("spend").alias("min_spend"),
        F.max("spend").alias("max_spend"))
    return (g.select(*keys, "channel", "mean_spend", "stddev_spend",
                     guarded_ratio("stddev_spend", "mean_spend").alias("cv_spend"),
                     "min_spend", "max_spend", (F.col("max_spend") - F.col("min_spend")).alias("range_spend"))
            .orderBy(*keys, F.col("cv_spend").asc_nulls_first(), "channel"))


def _trailing(df: DataFrame, cols: Sequence[str], part: str, k: int, exact: bool) -> DataFrame:
    """Add ``_roll_<col>``: the trailing K-row sum of each non-NULL column, if exact as a running sum
    minus the running sum K rows back (O(1) per row, see attribution)."""
    if not exact:
        frame = f"OVER ({part}ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        return df.selectExpr("*", *[f"SUM({_q(c)}) {frame} AS {_q('_roll_' + c)}" for c in cols])
    w_cum = f"OVER ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w_lag = f"OVER ({part}ORDER BY date)"
    cum = df.selectExpr("*", *[f"SUM({_q(c)}) {w_cum} AS {_q('_cum_' + c)}" for c in cols])
    return cum.selectExpr("*", *[f"{_q('_cum_' + c)} - COALESCE(LAG({_q('_cum_' + c)}, {k}) {w_lag}, 0) "
                                 f"AS {_q('_roll_' + c)}" for c in cols])


def _revenue_or_zero() -> str:
    return "COALESCE(CAST(revenue AS DOUBLE), 0D) AS revenue"


def _rolled(df: DataFrame, cols: Sequence[str], series: Sequence[str], k: int, exact: bool,
            block_steps: int | None) -> DataFrame:
    """``_trailing`` per series, in blocks if asked for; halo rows are gone afterwards."""
    if block_steps is not None:
        df, series = in_blocks(df, series, block_steps, k), [*series, BLOCK]
    return _trailing(df, cols, _partition(series), k, exact).where(f"NOT {HALO}")


def _share_long(spend_long: DataFrame, revenue: DataFrame, k: int, keys: Sequence[str], label_suffix: str,
                history: DataFrame | None, block_steps: int | None) -> DataFrame:
    kq = [_q(x) for x in keys]
    rows = with_history(spend_long.select(*keys, "date", "channel", "spend"), history)
    daily = (rows.groupBy(*keys, "date", F.concat(F.col("channel"), F.lit(label_suffix)).alias("channel"), HALO)
             .agg(F.coalesce(total(spend_long, "spend"), F.lit(0)).alias("spend")))
    kind = exact_type(spend_long, ["spend"])
    daily = daily.selectExpr("*", f"CAST(spend AS {kind}) AS _c")
    roll_c = _rolled(daily, ["_c"], [*keys, "channel"], k, kind != "DOUBLE", block_steps)
    day = daily.groupBy(*keys, "date", HALO).agg(total(daily, "_c").alias("_ct"))
    roll_t = _rolled(day, ["_ct"], list(keys), k, kind != "DOUBLE", block_steps).selectExpr(*kq, "date", "_roll__ct")
    rev = revenue.select(*keys, "date", "revenue")
    return (join_on(join_on(roll_c, roll_t, keys), rev, keys, how="left")
            .selectExpr(*kq, "channel", "spend", "_roll__c AS roll_channel", "_roll__ct AS roll_total",
                        _revenue_or_zero()))


def _share_wide(spend_wide: DataFrame, revenue: DataFrame, k: int, keys: Sequence[str], channels: Sequence[str],
                suffix: str, label_suffix: str, history: DataFrame | None, block_steps: int | None) -> DataFrame:
    cols = {c: f"{c}{suffix}" for c in channels}
    kq, kind = [_q(x) for x in keys], exact_type(spend_wide, list(cols.values()))
    base = with_history(spend_wide.select(*keys, "date", *cols.values()), history).selectExpr(
        *kq, "date", HALO,
        *[f"COALESCE({_q(col)}, 0) AS {_q(c)}" for c, col in cols.items()],
        *[f"CAST(COALESCE({_q(col)}, 0) AS {kind}) AS {_q('_c_' + c)}" for c, col in cols.items()])
    base = base.selectExpr("*", f"{' + '.join(_q('_c_' + c) for c in channels)} AS _c_total")
    rolled = _rolled(base, [f"_c_{c}" for c in channels] + ["_c_total"], list(keys), k, kind != "DOUBLE", block_steps)
    joined = join_on(rolled, revenue.select(*keys, "date", "revenue"), keys, how="left")
    rows = ", ".join(f"named_struct('channel', '{c}{label_suffix}', 'spend', {_q(c)}, "
                     f"'roll_channel', {_q('_roll__c_' + c)})" for c in channels)
    return joined.selectExpr(*kq, f"inline(array({rows}))", "_roll__c_total AS roll_total", _revenue_or_zero())


def channel_roas_summary(spend: DataFrame, revenue: DataFrame, k: int = 30, keys: Sequence[str] = (),
                         label_suffix: str = "_spend", channels: Sequence[str] = CHANNELS,
                         suffix: str = SPEND_SUFFIX, history: DataFrame | None = None,
                         block_steps: int | None = None) -> DataFrame:
    """Per channel: total_spend, attr_rev_30d, roas_30d (0 when no spend), as the reallocation reads them.

    Unlike the rolling attribution, NULL spend counts as 0, the denominator is the trailing
    sum of the day's total spend, and spend days without revenue stay (revenue 0). The
    total's window is keyed by entity only: it runs over one row per date, so a window
    partition holds at most the number of distinct dates of one entity (of a block, with
    ``block_steps``). ``history`` holds earlier spend that only the windows see.
    """
    if is_long(spend):
        share = _share_long(spend, revenue, k, keys, label_suffix, history, block_steps)
    else:
        share = _share_wide(spend, revenue, k, keys, channels, suffix, label_suffix, history, block_steps)
    share = share.withColumn("attributed_revenue_30d",
                             F.expr(_attributed_sql("roll_channel", "roll_total", "revenue")))
    s = share.groupBy(*keys, "channel").agg(total(share, "spend").alias("total_spend"),
                                            total(share, "attributed_revenue_30d").alias("attr_rev_30d"))
    return s.withColumn("roas_30d", F.coalesce(guarded_ratio("attr_rev_30d", "total_spend"), F.lit(0.0)))


def budget_reallocation(spend: DataFrame, revenue: DataFrame, k: int = 30, fraction: float = 0.10,
                        n_donors: int = 2, n_recipients: int = 2, keys: Sequence[str] = (),
                        label_suffix: str = "_spend", history: DataFrame | None = None,
                        block_steps: int | None = None) -> DataFrame:
    """Move ``fraction`` of spend from the lowest-ROAS channels (rank <= n_donors ascending) to
    the highest (rank <= n_recipients descending), split evenly; expected revenue at constant ROAS.

    Output (rounded like the reference: money 2 digits, ROAS 6): channel, total_spend,
    roas_30d, new_total_spend, exp_rev_before, exp_rev_after, incr_rev; best ROAS first.
    Ranks are RANK() on the ROAS itself. The channels that give and take, and the pool, come from aggregates that merge
    (one row per key), so the channels of a key may be any number.
    """
    s = shared(channel_roas_summary(spend, revenue, k, keys, label_suffix, history=history, block_steps=block_steps),
               "channel")
    spend_d, roas = F.col("total_spend").cast("double"), F.col("roas_30d")
    out = f"CASE WHEN roas_30d <= _low THEN {float(fraction)!r}D * CAST(total_spend AS DOUBLE) END"
    bounded = with_facts(s, rank_bounds(s, "roas_30d", n_donors, n_recipients, keys), keys)
    pool = (bounded.groupBy(*keys) if keys else bounded.groupBy()).agg(
        exact_sum(out).alias("_pool"), F.count_if(roas >= F.col("_high")).alias("_n_rec"),
        F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    given = F.when(roas >= F.col("_high"), F.col("_pool") / F.col("_n_rec"))
    delta = F.coalesce(given, F.lit(0.0)) - F.coalesce(F.expr(out), F.lit(0.0))
    impact = with_facts(s, pool, keys).select(*keys, "channel", spend_d.alias("total_spend"), "roas_30d",
                                              (spend_d + delta).alias("new_total_spend"))
    return (impact.select(
        *keys, "channel",
        F.round("total_spend", 2).alias("total_spend"),
        F.round(roas, 6).alias("roas_30d"),
        F.round("new_total_spend", 2).alias("new_total_spend"),
        F.round(F.col("total_spend") * roas, 2).alias("exp_rev_before"),
        F.round(F.col("new_total_spend") * roas, 2).alias("exp_rev_after"),
        F.round((F.col("new_total_spend") - F.col("total_spend")) * roas, 2).alias("incr_rev"))
        .orderBy(*keys, F.col("roas_30d").desc(), "channel"))
