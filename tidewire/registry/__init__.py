"""Registered queries: each a Spark function and, where SQL can say it, its SQL.

A registered function takes ``(spark, sf_dir)``.  Inputs are the given tables, or
rows that Spark derives from them by the rules written beside each query.
"""
