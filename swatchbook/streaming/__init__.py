"""Incremental ingestion of image files."""
