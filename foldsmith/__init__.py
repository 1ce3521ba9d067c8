"""Feature building, model runs and blending for tabular prediction, expressed as Spark jobs."""

__version__ = "0.1.0"
