"""Column expressions: text, words, dates, scores and page markup."""
