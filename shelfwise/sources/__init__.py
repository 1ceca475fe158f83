"""Readers, sinks, landed tables and generators."""
