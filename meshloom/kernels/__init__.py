"""Sequential cores on arrays, for graphs that fit one task."""
