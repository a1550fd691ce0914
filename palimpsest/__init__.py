"""palimpsest: a PySpark-native retrieval and analytics engine for long-lived text records."""
