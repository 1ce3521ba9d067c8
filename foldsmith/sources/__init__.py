"""Readers and writers: tables, feature store, prediction store, submission files."""
