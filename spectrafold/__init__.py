"""Spark-native spectral unmixing over corpora of hyperspectral images held as tables."""

__version__ = "0.1.0"
