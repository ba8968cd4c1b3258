"""Column expressions: text, matching, classification and scores."""
