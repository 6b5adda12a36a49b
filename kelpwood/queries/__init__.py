"""Operators as queries over the test tables, each with equivalent SQL where SQL can say it."""
