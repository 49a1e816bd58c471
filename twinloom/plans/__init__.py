"""Checked queries, the views they read and the end-to-end release plan."""
