"""Operators of a training-data pipeline over the tables documents, benchmark,
labels, pages and conversations.  Nothing outside this folder imports it."""
