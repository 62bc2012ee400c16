"""Incremental runs: files are taken once, and replaying a batch changes nothing."""
