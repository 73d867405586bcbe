"""Readers and writers: files, line formats, tables, checkpoints."""
