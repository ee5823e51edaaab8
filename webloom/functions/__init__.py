"""Column functions: URLs, text, HTML and address scanning."""
