"""engram: Spark-native memory retrieval, governance and telemetry analytics."""
