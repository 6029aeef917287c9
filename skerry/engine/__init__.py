"""The database layer: schema-inferring tables, DML, transactions and bindings over Spark SQL."""

from .database import Database

__all__ = ["Database"]
