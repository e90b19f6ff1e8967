"""Tables: metadata, catalog, scans, writers and commits."""
