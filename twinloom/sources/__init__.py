"""Readers, sinks and the logs a run leaves behind."""
