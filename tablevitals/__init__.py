"""Physical health of data-lake tables, for a whole catalog at once, on Spark."""

from .config import LayoutConfig
from .plans.analyze import Analysis, Inventories, analyze, run_analysis

__all__ = ["Analysis", "Inventories", "LayoutConfig", "analyze", "run_analysis"]
