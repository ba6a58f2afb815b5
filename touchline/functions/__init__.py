"""Feature and primitive expressions."""
