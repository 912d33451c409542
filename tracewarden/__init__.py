"""A PySpark-native engine for disclosure-risk analytics over question/answer text."""
