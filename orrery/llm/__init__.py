"""Training-data operators: ten corpus-scale building blocks on DataFrames.

Nothing else in the library imports this subpackage.
"""
