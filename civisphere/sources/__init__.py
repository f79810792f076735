"""Sources: every reader has an explicit schema and counts what it rejects."""
