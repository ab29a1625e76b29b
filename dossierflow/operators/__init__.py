"""Relational operators over case files; every one maps DataFrames to DataFrames."""
