"""The queries, each with its SQL twin."""
