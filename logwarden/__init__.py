"""Security-log analytics as Spark DataFrame jobs."""

from logwarden.config import Settings

__all__ = ["Settings"]
