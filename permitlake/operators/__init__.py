"""Generic table operators: joins, keyed writes, ids, change capture, data rules."""
