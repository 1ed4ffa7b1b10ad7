"""Column functions: text, URLs, scoring arithmetic, HTML node arrays."""
