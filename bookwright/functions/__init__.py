"""Column builders and the small per-row helpers behind Arrow functions."""
