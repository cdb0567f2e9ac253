"""Operators of a training-data pipeline: one module per operator, each a function over DataFrames."""
