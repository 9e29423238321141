"""lodestone: PySpark-native operators for long-term memory data."""
