"""Readers and the views the queries run over."""
