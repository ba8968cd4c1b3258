"""Stateful and windowed streams."""
