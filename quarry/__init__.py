"""Structural corpus engine on Spark: sources, operators, plans and streams over DataFrames."""
