"""Queries: each is a function of (spark, folder), with SQL beside it where SQL can say the same."""
