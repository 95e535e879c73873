"""Registered queries: each a Spark plan and, where SQL can say it, the same in SQL."""
