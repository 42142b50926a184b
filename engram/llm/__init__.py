"""Operators of a large-scale training-data pipeline.

Each module holds one operator with its own general interface and, where the
operator is dealt a contract query, a thin ``query(spark, sf_dir)`` that runs it
over the whole intended table.  Nothing outside this package imports it.
"""
