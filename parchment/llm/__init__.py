"""Training-data operators over a table of documents; nothing outside this folder imports it."""
