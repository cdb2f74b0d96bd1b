"""Ravelin: finds out what exported tables mean, on Spark DataFrames."""
