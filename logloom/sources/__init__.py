"""Readers and writers: log text, CSV tables, message queues, knowledge files."""
