"""Registered queries: every operator over the given tables, with an SQL twin where one exists."""
