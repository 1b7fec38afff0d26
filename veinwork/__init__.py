"""veinwork: typed knowledge graphs and causal graphs as Spark DataFrames."""

__version__ = "0.1.0"
