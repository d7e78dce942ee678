"""Lodestone: a record, graph and event query engine on PySpark."""

from lodestone.session import Session, new_spark

__all__ = ["Session", "new_spark"]
