"""Ranking many measured candidates per group, as Spark DataFrame operators."""
