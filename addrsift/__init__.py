"""Address and log analytics on Spark DataFrames."""

from .plans.dig import Options, dig, time_bounds
from .sources.lines import from_lines, number_lines, read_lines

__all__ = ["Options", "dig", "from_lines", "number_lines", "read_lines", "time_bounds"]
