"""Leakage-aware evaluation of labelled multichannel time series, on Spark."""
