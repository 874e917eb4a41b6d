"""Motorsport timing and telemetry analytics as Spark DataFrame jobs."""
