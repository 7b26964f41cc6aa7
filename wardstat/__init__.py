"""Cohort selection, grouped clinical reports and subgroup discovery on Spark DataFrames."""

__version__ = "0.1.0"
