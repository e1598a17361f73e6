"""Futures order-event analytics on Spark DataFrames."""
