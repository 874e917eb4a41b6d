"""Compositions of several operators into one DAG."""
