"""Scan jobs: text and JSON records to the library's tables, and the dated tables themselves."""
