"""Behavioural time-series and feature-table analytics on Spark DataFrames."""
