"""Queries: operators bound to tables, each with the SQL it must equal."""
