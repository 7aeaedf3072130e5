"""Run every report over the three daily feeds and export them.

    python -m spendlens --spend feeds/spend --revenue feeds/revenue --factors feeds/factors \
        --out results [--format csv|parquet] [--only attribution_windows,budget_reallocation] [--keys region] [--real]

Feeds are CSV with a header (or parquet with --input-format parquet) in the declared schemas;
duplicate dates are allowed and resolved by arrival order. With --keys, the feeds hold these entity columns, and
every report is made per entity. With --real, amounts are doubles of any number of digits instead of decimals of six.
A report becomes one CSV file with quoted header and text, under the name that it is published by.
"""

from __future__ import annotations

import argparse

from spendlens.plans.prepared import prepare
from spendlens.plans.report import PUBLISHED, export_reports
from spendlens.session import get_session
from spendlens.sources.feeds import read_feeds


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="spendlens")
    ap.add_argument("--spend", required=True)
    ap.add_argument("--revenue", required=True)
    ap.add_argument("--factors", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="csv")
    ap.add_argument("--input-format", default="csv")
    ap.add_argument("--only", default="")
    ap.add_argument("--keys", default="")
    ap.add_argument("--real", action="store_true")
    ap.add_argument("--master", default="local[*]")
    return ap


def run(argv, spark) -> list[str]:
    """Export the reports with a given session; returns the report names written."""
    args = _parser().parse_args(argv)
    keys = [k for k in args.keys.split(",") if k]
    feeds = read_feeds(spark, args.spend, args.revenue, args.factors, fmt=args.input_format, keys=keys,
                       real=args.real)
    names = {n for n in args.only.split(",") if n} or None
    written = export_reports(prepare(feeds, keys), args.out, fmt=args.format, names=names)
    for name in written:
        print(f"wrote {args.out}/{PUBLISHED.get(name, name + '.csv') if args.format == 'csv' else name}")
    return written


def main(argv=None) -> None:
    args = _parser().parse_args(argv)
    spark = get_session(master=args.master)
    try:
        run(argv, spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
