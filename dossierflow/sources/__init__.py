"""Readers of landed and staged files, writers of stage tables, and the state store."""
