"""Readers and writers of task sets, generation logs and run files."""
