"""Operators composed into the jobs that users run."""
