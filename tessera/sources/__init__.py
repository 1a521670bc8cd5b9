"""Where files, changes, history and rules come from, and where results go."""
