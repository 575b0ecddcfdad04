"""Spark-native analytics for labelled point clouds, raster fields and feature matrices."""
