"""Meshfree analytics over scattered point data, expressed as Spark DataFrames."""
