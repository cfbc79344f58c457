"""Intake of exchanged documents and versioned table storage."""
