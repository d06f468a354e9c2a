"""Readers and writers: raw logs, event tables, model tables, history."""
