"""Read-only sources of vector corpora."""
