"""Column functions on texts, dates, URLs and categories."""
