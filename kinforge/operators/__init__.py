"""Operators over DataFrames: plans in, plans out."""
