"""Operators of a training-data pipeline on Spark.

Nothing else in the package imports this subpackage.  Each module holds one
operator with its general interface; :mod:`shroud.llm.queries` registers the
queries over the supplied tables and :mod:`shroud.llm.oracles` their SQL.
"""
