"""Column builders: paths, globs, patterns and text clean-up."""
