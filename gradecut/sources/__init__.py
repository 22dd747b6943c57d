"""Readers and writers. Schemas are explicit and malformed input fails."""
