"""Relational operators over fact tables, as functions from DataFrames to DataFrames."""
