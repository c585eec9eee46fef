from runquarry.streaming.halving import current_decisions, start_halving
from runquarry.streaming.latest import current_latest_metrics, fold_latest_metrics, start_latest_metrics

__all__ = ["current_decisions", "current_latest_metrics", "fold_latest_metrics", "start_halving", "start_latest_metrics"]
