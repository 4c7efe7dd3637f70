"""Table schemas, reading and writing."""
