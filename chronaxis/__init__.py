"""Trajectory analytics and evidence audit on Spark DataFrames."""
