"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it; ``queries.py`` holds the
registered queries and their SQL.
"""
