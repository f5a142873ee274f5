"""Scoring, judging and cost accounting of model outputs as Spark DataFrames."""
