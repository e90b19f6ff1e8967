"""Commands that change tables."""
