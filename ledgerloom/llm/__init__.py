"""Training-data operators.

Nothing else in the library imports this subpackage. Every operator is a function from DataFrames
to DataFrames in a module of its own; ``queries`` registers one query for each.
"""
