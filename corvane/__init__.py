"""Instruction-data preparation and evaluation analytics as Spark DataFrames."""
