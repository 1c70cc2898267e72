"""DataFrame -> DataFrame building blocks.

Each operator returns a lazy plan, except those in ``ordering``, which checkpoint one sorted table.
No operator caches, collects rows or uses a Python UDF.
"""
