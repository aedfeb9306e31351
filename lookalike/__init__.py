"""Near-duplicate analytics and media-library curation on Spark DataFrames."""

from .config import Config
from .engine import Engine, Scan

__version__ = "0.1.0"
__all__ = ["Config", "Engine", "Scan"]
