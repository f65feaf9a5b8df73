"""Readers and writers for caption folders, label tables, dimensions and model-file headers."""
