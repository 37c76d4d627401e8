"""Agent-activity analytics as Spark DataFrame operators."""
