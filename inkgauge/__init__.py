"""inkgauge: text-provenance analytics over document corpora, on Spark DataFrames."""

__version__ = "0.1.0"
