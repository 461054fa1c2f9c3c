"""Readers and writers: models, frame files, event files."""
