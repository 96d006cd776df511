"""Billing-intelligence operators over Spark DataFrames and streams."""
