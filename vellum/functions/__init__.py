"""Column functions: every function takes and returns ``Column`` and stays inside Catalyst."""
