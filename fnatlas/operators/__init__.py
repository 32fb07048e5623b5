"""Operators from DataFrame to DataFrame, keyed by fn_id."""
