"""Incremental profiling of arriving rows."""
