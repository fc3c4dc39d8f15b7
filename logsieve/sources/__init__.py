"""Reading, validating and writing files and records."""
