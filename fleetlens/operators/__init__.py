"""Operators: DataFrame in, DataFrame out (or a predicate column), always lazy."""
