"""Spark-native analysis of file collections, source code and package metadata."""
