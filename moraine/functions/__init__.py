"""Types, literals and partition transforms."""
