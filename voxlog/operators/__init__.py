"""Reads, writes and maintenance as operations on DataFrames."""
