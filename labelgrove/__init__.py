"""Hierarchical, partially observed labels and model scores as Spark DataFrames."""
