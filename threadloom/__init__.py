"""Spark-native preparation of threaded conversations and corpora for language-model training."""
