"""Column functions: line parsing, route normalisation, states."""
