"""Readers and writers of the recognition dataflow's files."""
