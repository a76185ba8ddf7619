"""Comparison, evaluation, metering and verification over DataFrames."""
