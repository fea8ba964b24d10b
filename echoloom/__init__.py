"""Analytics of time-stamped acoustic detections on Spark."""

__version__ = "0.1.0"
