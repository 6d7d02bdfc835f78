"""Whole data flows: each plan is a lazy function from tables to a table."""
