"""Readers and writers: tables, log trees, landings, change topics, snapshots."""
