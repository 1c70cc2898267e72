"""Operators for preparing training text.

Nothing outside this folder imports it. Python code runs inside tasks only, on Arrow batches that
Spark partitions; NULL texts count as empty texts everywhere, extra columns are ignored.
"""
