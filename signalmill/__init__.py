"""Labelling, verification and settlement of text signals, as Spark plans."""
