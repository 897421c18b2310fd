"""Column expressions: calendar, text, rates, distributions, tests."""
