"""Registries, readers, sinks and a REST source."""
