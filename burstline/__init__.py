"""burstline: bursty-event analytics over short-text streams, on PySpark."""

__version__ = "0.1.0"
