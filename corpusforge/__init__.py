"""corpusforge: Spark-native knowledge-corpus operators."""
