"""Whole runs built from the operators: the batch job and the query registry."""
