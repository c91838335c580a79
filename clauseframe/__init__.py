"""Segmentation and analysis of structured regulatory text with Spark DataFrames."""
