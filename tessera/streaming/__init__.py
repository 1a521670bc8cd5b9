"""Watching a repository as a stream."""
