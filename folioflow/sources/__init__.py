"""Readers and writers for the tables of the nightly run."""
