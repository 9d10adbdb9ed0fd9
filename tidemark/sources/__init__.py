"""Readers and writers of datasets."""
