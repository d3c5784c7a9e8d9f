"""Telemetry analytics for large database fleets, written as Spark DataFrame plans."""
