"""Fleet telemetry analytics as lazy Spark DataFrame operators and streams."""

__version__ = "0.1.0"
