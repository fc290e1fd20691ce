"""Reusable operators on DataFrames that are more than one built-in function."""
