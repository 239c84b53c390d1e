"""Operators for preparing language-model training data on Spark.

Nothing else in the package imports this subpackage; it can be deleted whole.
"""
