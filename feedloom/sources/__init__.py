"""Readers of stored tables, feed documents, timelines and usage logs, and the writers of snapshots."""
