"""factloom: probabilistic-logic analytics over text and tables, expressed as Spark DataFrames."""

__version__ = "0.1.0"
