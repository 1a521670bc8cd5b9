"""Repository graphs as DataFrames: snapshots, typed property graphs, drift meters, rule gates."""
