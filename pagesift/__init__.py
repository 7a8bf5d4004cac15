"""Sort, featurise, score and self-train page-sample corpora with Spark DataFrames."""

__version__ = "0.1.0"
