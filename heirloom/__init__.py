"""heirloom: training datasets with a traceable origin, as Spark DataFrame jobs."""

__version__ = "0.1.0"
