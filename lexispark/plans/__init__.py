"""Query languages, parsed to plain data."""
