"""Readers, writers, generated data and the mapping of the test tables onto the entity model."""
