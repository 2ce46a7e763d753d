"""Operators over conflict data, as functions from DataFrames or Columns to the same."""
