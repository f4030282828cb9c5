"""Spark-native analytics over sparse voxel slices and utility lines."""
