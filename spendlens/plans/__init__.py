from spendlens.plans.prepared import Prepared, materialize, prepare

__all__ = ["Prepared", "prepare", "materialize"]
