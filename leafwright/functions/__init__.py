"""Column functions: regular expressions, page text, masking."""
