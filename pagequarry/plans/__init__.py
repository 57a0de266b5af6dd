"""Registered queries over the test tables, each with its oracle where SQL can say it."""
