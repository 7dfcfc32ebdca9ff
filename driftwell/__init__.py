"""driftwell: fluctuation mining and time-series processing as chainable Spark DataFrame operators."""

__version__ = "0.1.0"
