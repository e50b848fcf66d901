"""Customer-event analytics on Spark: identity, sessions, profiles, an OLAP store and its query catalogue."""

__version__ = "0.1.0"
