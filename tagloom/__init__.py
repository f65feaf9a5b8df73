"""Spark operators for curating large tables of tagged captions."""
