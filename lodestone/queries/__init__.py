"""The engine's registered queries and, for each, the SQL an independent engine can run."""

from . import dataframes, files, statements, texts, tpch

#: name -> function of a session and a folder of tables.
QUERIES = texts.QUERIES | dataframes.QUERIES | tpch.QUERIES | files.QUERIES | statements.QUERIES
#: name -> DuckDB's SQL for the same rows.
ORACLES = texts.ORACLES | dataframes.ORACLES | tpch.ORACLES | files.ORACLES | statements.ORACLES
