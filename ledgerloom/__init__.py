"""ledgerloom: entity-resolved, time-aware event-panel analytics on PySpark."""

__version__ = "0.1.0"
