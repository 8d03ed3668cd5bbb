"""lectern: a PySpark-native engine for analysing and retrieving from document corpora."""
