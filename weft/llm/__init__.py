"""Operators for preparing large text corpora.

Every module here stands on its own on top of PySpark, numpy and pyarrow; no
other part of the library imports this subpackage.
"""
