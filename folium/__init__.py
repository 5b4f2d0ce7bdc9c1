"""Folium: a Spark-native engine for document-extraction analytics."""
