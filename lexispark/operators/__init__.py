"""The index and the query modes."""
