"""Literal row-by-row implementation of the reference semantics, for small fixtures.

Follows the reference queries step by step (NULL handling of SUM, CASE guards, inner versus
left joins) without any Spark, as an oracle independent of both engines.
"""

import math
from collections import defaultdict
from decimal import Decimal


def _sum(values):
    vals = [v for v in values if v is not None]
    return sum(vals) if vals else None


def rolling_fact(spend, revenue, k):
    """spend: {date: {channel: value|None}} (one row per date); revenue: {date: value}.
    Returns [(date, channel, spend, attributed)] for dates with revenue (inner join)."""
    dates = sorted(spend)
    channels = sorted({c for d in dates for c in spend[d]})
    rolling = {}
    for c in channels:
        series = [(d, spend[d].get(c)) for d in dates if c in spend[d]]
        for i, (d, _) in enumerate(series):
            rolling[(d, c)] = _sum(v for _, v in series[max(0, i - k + 1): i + 1])
    out = []
    for d in dates:
        total = _sum(rolling[(d, c)] for c in channels if (d, c) in rolling)
        if d not in revenue:
            continue
        for c in channels:
            if (d, c) not in rolling:
                continue
            r = rolling[(d, c)]
            if total is not None and total > 0:
                attr = None if r is None or revenue[d] is None else revenue[d] * (r / total)
            else:
                attr = 0.0
            out.append((d, c, spend[d][c], attr))
    return out


def rolling_attribution(spend, revenue, k):
    """{channel: (total_spend, total_attributed, roas)}"""
    acc = defaultdict(lambda: [[], []])
    for d, c, s, a in rolling_fact(spend, revenue, k):
        acc[c][0].append(s)
        acc[c][1].append(a)
    out = {}
    for c, (ss, aa) in acc.items():
        ts, ta = _sum(ss), _sum(aa)
        out[c] = (ts, ta, (ta / ts) if ts is not None and ts > 0 and ta is not None else None)
    return out


def reallocation(spend, revenue, k=30, fraction=0.10, n=2):
    """{channel_spend: (total_spend, roas, new_total)} following the budget query."""
    dates = sorted(spend)
    channels = sorted({c for d in dates for c in spend[d]})
    daily = {(d, c): Decimal(str(spend[d].get(c) or 0)) for d in dates for c in channels}
    total = {d: sum(daily[(d, c)] for c in channels) for d in dates}
    spent, gains = defaultdict(Decimal), defaultdict(list)
    for i, d in enumerate(dates):
        window = dates[max(0, i - k + 1): i + 1]
        rt = float(sum(total[x] for x in window))
        for c in channels:
            rc = float(sum(daily[(x, c)] for x in window))
            share = rc / rt if rt > 0 else 0.0
            spent[c] += daily[(d, c)]
            gains[c].append((revenue.get(d) or 0.0) * share)
    # money is summed exactly, and a total of doubles is rounded once; ranks are on the values themselves
    rows = {c: (float(s), (math.fsum(gains[c]) / float(s)) if s > 0 else 0.0) for c, s in spent.items()}
    key = {c: r for c, (_, r) in rows.items()}
    desc_rank = {c: 1 + sum(1 for x in key.values() if x > key[c]) for c in rows}
    asc_rank = {c: 1 + sum(1 for x in key.values() if x < key[c]) for c in rows}
    donors = [c for c in rows if asc_rank[c] <= n]
    recips = [c for c in rows if desc_rank[c] <= n]
    pool = math.fsum(fraction * rows[c][0] for c in donors)
    out = {}
    for c, (s, r) in rows.items():
        delta = (pool / len(recips) if c in recips else 0.0) - (fraction * s if c in donors else 0.0)
        out[f"{c}_spend"] = (s, r, s + delta)
    return out


def curves(spend, revenue, bins):
    """Same-day attribution, rows ranked per channel by (spend, date) with NULLs first.
    Returns ({(channel, bin): (avg_spend, avg_attr)}, {channel: (baseline, higher)})."""
    fact = rolling_fact(spend, revenue, 1)
    by_channel = defaultdict(list)
    for d, c, s, a in fact:
        by_channel[c].append((d, s, a))
    out_bins, out_incr = {}, {}
    for c, rows in by_channel.items():
        rows.sort(key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))
        n = len(rows)
        groups = defaultdict(list)
        low, high = [], []
        for i, (d, s, a) in enumerate(rows, start=1):
            groups[((i - 1) * bins) // n + 1].append((s, a))
            (low if i * 10 <= n else high).append(a)
        for b, vals in groups.items():
            ss = [s for s, _ in vals if s is not None]
            aa = [a for _, a in vals if a is not None]
            out_bins[(c, b)] = (sum(ss) / len(ss) if ss else None, sum(aa) / len(aa) if aa else None)
        lo = [a for a in low if a is not None]
        hi = [a for a in high if a is not None]
        out_incr[c] = (sum(lo) / len(lo) if lo else None, sum(hi) / len(hi) if hi else None)
    return out_bins, out_incr
