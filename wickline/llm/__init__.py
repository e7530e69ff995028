"""Operators for preparing language-model training data, re-expressed on Spark.

Nothing else in the library imports this subpackage; deleting it leaves the
rest working.  ``wickline.llm.registry`` holds its queries.
"""
