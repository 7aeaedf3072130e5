"""spendlens: spend attribution and revenue analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; all heavy work is expressed
with Spark built-ins so Catalyst can prune, push down and plan the shuffles.
"""

from spendlens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
