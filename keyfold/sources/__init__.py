"""Readers and writers of tables and of the log file format."""
