"""Column expressions: text, emoji, dates and model scores."""
