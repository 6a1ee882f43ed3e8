"""Evaluation analytics on Spark: scoring, folding, gating and preparing test cases as DataFrames."""
