"""Structured Streaming monitor: live sessions, alerts, quarantine."""
