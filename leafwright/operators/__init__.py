"""Relational operators over page packages: DataFrame in, DataFrame out."""
