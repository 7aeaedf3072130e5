"""Spend-share revenue attribution: same day (A13), trailing K rows (A14), several K at
once (A15), and the attributed fact that the breakdown and curve operators share.

Spend may come wide (one row per (keys, date), one column per channel, as the feed
arrives) or long (keys, date, channel, spend).

Wide plan: one Window keyed by the entity columns and ordered by date evaluates every
channel and every K in a single sort; the day's total of the rolling sums is a row-wise
sum, so no shuffle by channel or by date is needed. A window partition holds one row per
date of one entity, i.e. at most the number of distinct dates (not a data-sized group), or of
one block of dates, where ``block_steps`` cuts long series.

Long plan: one Window partitioned by (keys, channel) ordered by date evaluates every K in
a single sort; one Window partitioned by (keys, date) gives the day's total (no self join).

Either way the revenue join is an equi join on (keys, date), where a NULL key is an entity like
any other, and spend days without revenue drop out there, after the rolling sums. Attributed
revenue is summed exactly, in any order (see ``functions.exact``).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.columns import guarded_ratio
from spendlens.functions.exact import total
from spendlens.functions.joins import join_on
from spendlens.operators.blocks import BLOCK, HALO, in_blocks, with_history
from spendlens.sources.schemas import CHANNELS, SPEND_SUFFIX

def _windows(windows: Iterable[int]) -> list[int]:
    wins = sorted(set(int(k) for k in windows))
    if not wins or wins[0] < 1:
        raise ValueError("window sizes must be >= 1")
    return wins


def is_long(spend: DataFrame) -> bool:
    return "channel" in spend.columns


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# Trailing sums keep every digit of the spend. On DECIMAL spend (up to 6 digits after the
# point) and integers they are exact, and a K-row trailing sum is a difference of running sums,
# cum(i) - cum(i - K): the running sum is an incremental frame and LAG an offset, both O(1) per
# row, whereas a sliding ROWS frame re-adds the whole frame for every row (O(K) per row and
# expression). A running count of non-NULL values keeps SUM's rule that a frame of NULLs sums to
# NULL. DOUBLE spend is summed over the sliding frame itself, as differences of running sums
# would lose small amounts; so is the calendar-day form (RANGE). Everything is written as SQL
# expression strings: dozens of per-channel expressions cost one JVM call each.

EXACT_SCALE = 6


def exact_type(df: DataFrame, cols: Sequence[str]) -> str:
    """SQL type that holds sums of the columns: DECIMAL(38, scale) if that is exact, else DOUBLE."""
    kinds = [df.schema[c].dataType for c in cols]
    scales = [k.scale if isinstance(k, T.DecimalType) else 0 if isinstance(k, T.IntegralType) else None for k in kinds]
    if any(s is None or s > EXACT_SCALE for s in scales):
        return "DOUBLE"
    return f"DECIMAL(38,{max(scales)})"


def _prefix_sql(v: str, part: str) -> list[str]:
    w = f"OVER ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return [f"SUM(COALESCE({_q(v)}, 0)) {w} AS {_q('_cum' + v)}", f"COUNT({_q(v)}) {w} AS {_q('_n' + v)}"]


def _trailing_sql(v: str, k: int, part: str, frame: str, exact: bool) -> str:
    if frame == "rows" and not exact and k > 1:
        return f"SUM({_q(v)}) OVER ({part}ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    if frame == "days":
        return f"SUM({_q(v)}) OVER ({part}ORDER BY unix_date(date) RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    if k == 1:
        return _q(v)
    w = f"OVER ({part}ORDER BY date)"
    n, cum = _q("_n" + v), _q("_cum" + v)
    return (f"CASE WHEN {n} - COALESCE(LAG({n}, {k}) {w}, 0) > 0 "
            f"THEN {cum} - COALESCE(LAG({cum}, {k}) {w}, 0) END")


def _attributed_sql(rolling: str, total: str, revenue: str) -> str:
    """revenue * rolling / total when the day's total is positive, else 0, in DOUBLE."""
    return (f"CASE WHEN {total} > 0 THEN CAST({revenue} AS DOUBLE) * "
            f"(CAST({rolling} AS DOUBLE) / CAST({total} AS DOUBLE)) ELSE 0D END")


def _partition(cols: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(_q(c) for c in cols)} " if cols else ""


def _fact_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.selectExpr(*[_q(k) for k in keys], "date", "channel", "spend", "k",
                         "_rc AS rolling_spend", "_tc AS total_rolling_spend",
                         "revenue", "attributed_revenue")


def _rows_to_roll(spend: DataFrame, history: DataFrame | None, series: list[str], k: int, frame: str,
                  block_steps: int | None) -> tuple[DataFrame, list[str]]:
    """The rows of all windows, with ``_halo``, and the columns of a window partition."""
    rows = with_history(spend, history)
    if block_steps is None:
        return rows, series
    return in_blocks(rows, series, block_steps, k, days=frame == "days"), [*series, BLOCK]


def _fact_long(spend_long: DataFrame, revenue: DataFrame, wins: list[int], keys: list[str], frame: str,
               history: DataFrame | None, block_steps: int | None) -> DataFrame:
    kq = [_q(k) for k in keys]
    kind = exact_type(spend_long, ["spend"])
    exact = kind != "DOUBLE"
    rows, series = _rows_to_roll(spend_long.select(*keys, "date", "channel", "spend"), history, [*keys, "channel"],
                                 wins[-1], frame, block_steps)
    part = _partition(series)
    step = rows.selectExpr("*", f"CAST(spend AS {kind}) AS _v")
    if frame == "rows" and wins[-1] > 1 and exact:
        step = step.selectExpr("*", *_prefix_sql("_v", part))
    rolled = step.selectExpr("*", *[f"{_trailing_sql('_v', k, part, frame, exact)} AS _r{k}" for k in wins]) \
        .where(f"NOT {HALO}")
    day = _partition([*keys, "date"])
    totals = rolled.selectExpr("*", *[f"SUM(_r{k}) OVER ({day}) AS _t{k}" for k in wins])
    joined = join_on(totals, revenue.select(*keys, "date", "revenue"), keys)
    structs = ", ".join(
        f"named_struct('k', {k}, '_rc', _r{k}, '_tc', _t{k}, "
        f"'attributed_revenue', {_attributed_sql(f'_r{k}', f'_t{k}', 'revenue')})"
        for k in wins)
    return _fact_columns(joined.selectExpr(*kq, "date", "channel", "spend", "revenue",
                                           f"inline(array({structs}))"), keys)


def _fact_wide(spend_wide: DataFrame, revenue: DataFrame, wins: list[int], keys: list[str], channels: Sequence[str],
               suffix: str, frame: str, history: DataFrame | None, block_steps: int | None) -> DataFrame:
    cols = {c: f"{c}{suffix}" for c in channels}
    kq = [_q(k) for k in keys]
    v = {c: f"_v_{c}" for c in channels}
    kind = exact_type(spend_wide, list(cols.values()))
    exact = kind != "DOUBLE"
    rows, series = _rows_to_roll(spend_wide.select(*keys, "date", *cols.values()), history, keys, wins[-1], frame,
                                 block_steps)
    part = _partition(series)
    step = rows.selectExpr("*", *[f"CAST({_q(col)} AS {kind}) AS {_q(v[c])}" for c, col in cols.items()])
    if frame == "rows" and wins[-1] > 1 and exact:
        step = step.selectExpr("*", *[e for c in channels for e in _prefix_sql(v[c], part)])
    rolled = step.selectExpr("*", *[f"{_trailing_sql(v[c], k, part, frame, exact)} AS {_q(f'_r{k}_{c}')}"
                                    for k in wins for c in channels]).where(f"NOT {HALO}")
    totals = []
    for k in wins:
        parts = [_q(f"_r{k}_{c}") for c in channels]
        totals.append(f"CASE WHEN {' OR '.join(p + ' IS NOT NULL' for p in parts)} "
                      f"THEN {' + '.join(f'COALESCE({p}, 0)' for p in parts)} END AS {_q(f'_t{k}')}")
    joined = join_on(rolled.selectExpr("*", *totals), revenue.select(*keys, "date", "revenue"), keys)
    structs = ", ".join(
        f"named_struct('channel', '{c}', 'spend', {_q(col)}, 'k', {k}, "
        f"'_rc', {_q(f'_r{k}_{c}')}, '_tc', {_q(f'_t{k}')}, "
        f"'attributed_revenue', {_attributed_sql(_q(f'_r{k}_{c}'), _q(f'_t{k}'), 'revenue')})"
        for k in wins for c, col in cols.items())
    return _fact_columns(joined.selectExpr(*kq, "date", "revenue", f"inline(array({structs}))"), keys)


def attributed_fact(spend: DataFrame, revenue: DataFrame, windows: Iterable[int] = (30,),
                    keys: Sequence[str] = (), channels: Sequence[str] = CHANNELS,
                    suffix: str = SPEND_SUFFIX, frame: str = "rows", history: DataFrame | None = None,
                    block_steps: int | None = None) -> DataFrame:
    """Per (keys, date, channel, k): spend, trailing-K spend, the day's total of those, revenue
    and attributed revenue. K = 1 is same-day attribution.

    ``spend`` is long (has a ``channel`` column) or wide (``<channel><suffix>`` columns).
    ``frame="rows"`` (the reference's semantics) counts K rows; ``frame="days"`` counts K
    calendar days, which differs only where dates are missing.

    ``history`` holds rows of spend before the first date (same shape), which the windows see and the result leaves
    out. ``block_steps`` rolls an entity in blocks of so many dates (see ``blocks``), for series too long for one task;
    the result is the same.
    """
    if frame not in ("rows", "days"):
        raise ValueError("frame must be 'rows' or 'days'")
    wins, keys = _windows(windows), list(keys)
    if is_long(spend):
        return _fact_long(spend, revenue, wins, keys, frame, history, block_steps)
    return _fact_wide(spend, revenue, wins, keys, channels, suffix, frame, history, block_steps)


def as_long(spend: DataFrame, keys: Sequence[str] = (), channels: Sequence[str] = CHANNELS,
            suffix: str = SPEND_SUFFIX) -> DataFrame:
    """Long spend (keys, date, channel, spend) from either shape (a single Expand if wide)."""
    if is_long(spend):
        return spend
    ids = [*keys, "date"]
    return (spend.select(*ids, *[F.col(f"{c}{suffix}").alias(c) for c in channels])
            .unpivot(ids, list(channels), "channel", "spend"))


def same_day_attribution(spend: DataFrame, revenue: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(channel, total_spend, total_revenue_attributed), largest spend first."""
    fact = attributed_fact(spend, revenue, (1,), keys)
    return (fact.groupBy(*keys, "channel")
            .agg(total(fact, "spend").alias("total_spend"),
                 total(fact, "attributed_revenue").alias("total_revenue_attributed"))
            .orderBy(*keys, F.col("total_spend").desc(), "channel"))


def _roas_by(fact: DataFrame, group: Sequence[str]) -> DataFrame:
    return (fact.groupBy(*group)
            .agg(total(fact, "spend").alias("total_spend"),
                 total(fact, "attributed_revenue").alias("total_revenue_attributed_k"))
            .withColumn("roas_k", guarded_ratio("total_revenue_attributed_k", "total_spend")))


def rolling_attribution(spend: DataFrame, revenue: DataFrame, k: int = 30,
                        keys: Sequence[str] = (), frame: str = "rows", history: DataFrame | None = None,
                        block_steps: int | None = None) -> DataFrame:
    """Trailing-K-row attribution: (channel, total_spend, total_revenue_attributed_k, roas_k,
    attribution_window_days), best ROAS first."""
    fact = attributed_fact(spend, revenue, (k,), keys, frame=frame, history=history, block_steps=block_steps)
    return (_roas_by(fact, [*keys, "channel"])
            .withColumn("attribution_window_days", F.lit(int(k)))
            .orderBy(*keys, F.col("roas_k").desc(), "channel"))


def attribution_windows(spend: DataFrame, revenue: DataFrame, windows: Iterable[int] = (7, 14, 30),
                        keys: Sequence[str] = (), frame: str = "rows", history: DataFrame | None = None,
                        block_steps: int | None = None) -> DataFrame:
    """All windows in one pass: (channel, attribution_window_days, total_spend,
    total_revenue_attributed_k, roas_k), by window then best ROAS."""
    fact = attributed_fact(spend, revenue, windows, keys, frame=frame, history=history, block_steps=block_steps)
    return (_roas_by(fact.withColumnRenamed("k", "attribution_window_days"),
                     [*keys, "channel", "attribution_window_days"])
            .select(*keys, "channel", "attribution_window_days", "total_spend", "total_revenue_attributed_k",
                    "roas_k")
            .orderBy(*keys, "attribution_window_days", F.col("roas_k").desc(), "channel"))
