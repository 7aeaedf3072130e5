from spendlens.sources.schemas import (CHANNELS, EXTERNAL_FACTORS, MARKETING_SPEND, MONEY, REVENUE,
                                       SPEND_SUFFIX, spend_columns)
from spendlens.sources.feeds import Feeds, read_feed, read_feeds, write_result
from spendlens.sources.driver_tables import driver_feeds, event_spend_long

__all__ = ["CHANNELS", "SPEND_SUFFIX", "MONEY", "MARKETING_SPEND", "REVENUE", "EXTERNAL_FACTORS",
           "spend_columns", "Feeds", "read_feed", "read_feeds", "write_result", "driver_feeds",
           "event_spend_long"]
