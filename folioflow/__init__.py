"""folioflow: recommendation and digest jobs over paper tables, written as Spark DataFrame plans."""

from folioflow.config import Settings

__all__ = ["Settings"]
