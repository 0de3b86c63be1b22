"""Operators of a training-data pipeline, each built by one named method.

Nothing else in the library imports this subpackage; its queries are listed in
``queries.QUERIES`` and their DuckDB SQL in ``queries.ORACLE_SQL``.
"""
