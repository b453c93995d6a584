"""All queries of the library but those of the optional subpackage."""

from . import command_queries, driver_queries, ledger_queries, reading_queries, rule_queries, small_queries, text_queries, version_queries  # noqa: F401  (all register in the same tables)

QUERIES = driver_queries.QUERIES
SQL = driver_queries.SQL
