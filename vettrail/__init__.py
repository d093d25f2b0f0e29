"""Outreach and document trust checks as Spark DataFrame operators."""
