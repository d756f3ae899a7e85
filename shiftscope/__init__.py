"""Upgrade-impact analytics as Spark DataFrame transforms."""
