"""Spark-native document text engine: cleaning, quality, fonts, segmentation, chunking, repair routing and ingestion as DataFrames."""
