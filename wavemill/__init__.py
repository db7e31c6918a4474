"""A PySpark-native engine for sampled signals: sources, framing, spectra, features, music analysis, learning tools."""

__version__ = "0.1.0"
