"""Readers and writers: text, markup, tables, office files, PDF, catalogs, and the project store."""
