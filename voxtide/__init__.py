"""Spark jobs over labelled voxel volumes, and a subpackage for text corpora."""
