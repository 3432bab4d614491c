"""Column builders. Each takes columns or column names and returns a ``Column``."""
