"""Prepared inputs: deduplicate each raw feed once and unpivot spend once, then let every
operator read the same DataFrames (the reference repeats this in every query).

``materialize`` cuts the lineage by writing the prepared tables to the session's
checkpoint folder (``spark.checkpoint.dir``), so a lost executor recomputes from the
written files instead of rescanning the raw feeds.
"""

from __future__ import annotations

from typing import Sequence

from spendlens.operators.shape import keep_first, unpivot_channels
from spendlens.session import cut
from spendlens.sources.feeds import INGEST_ORD, Feeds, Lazy
from spendlens.sources.schemas import CHANNELS, SPEND_SUFFIX


class Prepared(Lazy):
    """Deduplicated feeds: spend (wide), spend_long, revenue, factors; built on first use.

    ``spend_long`` is derived from ``spend`` (one Expand) unless given. ``history``, if given, holds the spend before
    the first date that trailing windows reach back to. ``raw`` holds the feeds as they arrived, for the data-quality
    reports.
    """

    _names = ("spend", "spend_long", "revenue", "factors", "history")

    def __init__(self, keys: Sequence[str] = (), channels=CHANNELS, suffix: str = SPEND_SUFFIX,
                 raw: Feeds | None = None, **sources):
        super().__init__(**sources)
        self.keys, self.channels, self.suffix, self.raw = tuple(keys), tuple(channels), suffix, raw
        self._sources.setdefault(
            "spend_long", lambda: unpivot_channels(self.spend, self.channels, self.suffix, self.keys))


def prepare(feeds: Feeds, keys: Sequence[str] = (), order=INGEST_ORD, channels=CHANNELS,
            suffix: str = SPEND_SUFFIX) -> Prepared:
    """Keep the first row per (keys, date) of each feed; the long spend table follows."""
    k = [*keys, "date"]
    return Prepared(
        keys, channels, suffix, feeds,
        spend=lambda: keep_first(feeds.spend, k, order).drop(order),
        revenue=lambda: keep_first(feeds.revenue, k, order).drop(order),
        factors=lambda: keep_first(feeds.factors, k, order).drop(order),
    )


def materialize(p: Prepared) -> Prepared:
    """Write the deduplicated feeds to the checkpoint folder and read them back."""
    feeds = {name: cut(getattr(p, name)) for name in ("spend", "revenue", "factors", "history") if hasattr(p, name)}
    return Prepared(p.keys, p.channels, p.suffix, p.raw, **feeds)
