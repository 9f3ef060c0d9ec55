"""Analytics of shuffled multi-document page packages on Spark, and operators for training corpora."""

__version__ = "0.1.0"
