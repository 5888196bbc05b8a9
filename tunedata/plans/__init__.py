"""Runnable queries over the test tables: adapters, one query per operator, and their SQL twins."""
