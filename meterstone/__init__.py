"""Token usage and cost analytics for coding-agent session logs, on Spark."""

__version__ = "0.1.0"
