"""Whole runs: index, diff, drift, review; and the virtual repository that queries run on."""
