"""ohmgrid: DC conduction analysis of circuit boards as Spark DataFrames."""

__version__ = "0.1.0"
