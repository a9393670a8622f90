"""Column functions: dates, text, parsing, hashing, normal distribution, bins."""
