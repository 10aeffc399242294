"""Agent-memory analytics on Spark."""
