"""Column expressions: text, time, money, pricing and report measures."""
