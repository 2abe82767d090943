"""sentrylake: host security telemetry analytics as Spark DataFrame operators."""
