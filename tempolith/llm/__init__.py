"""Training-data operators: sharding, tokenisation, joins, scans and filters over document tables.

Nothing else in the library imports this subpackage.
"""
