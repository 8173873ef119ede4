"""Registered queries: Spark programs over the driver's tables with their SQL twins."""
