"""Spark jobs over voxel volumes, cell tables and text corpora."""
