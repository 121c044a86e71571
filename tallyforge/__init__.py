"""tallyforge: a PySpark-native engine for graded responses, curated tables and training corpora."""
