"""Operators of a training-data pipeline over web documents.

Each module holds one operator with its own general interface; ``queries``
registers one ``opN_<name>`` query per operator and ``oracle`` the DuckDB SQL
of those that SQL can express.  Nothing else in the library imports this
subpackage.

Conventions shared by all operators: an operator reads only the columns it
names and drops every other one on entry, so extra columns with clashing names
cannot matter; rows are never dropped, capped or sampled to escape skew.
"""
