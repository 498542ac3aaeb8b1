"""Tidewell: media-library bookkeeping and training-data preparation as Spark plans."""

__version__ = "0.1.0"
