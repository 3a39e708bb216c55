"""Column functions: text, addresses, numbers and dates, rules."""
