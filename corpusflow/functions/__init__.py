"""Column functions: text, HTML, vectors."""
