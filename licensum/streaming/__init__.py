"""Continuous versions of the batch jobs."""
