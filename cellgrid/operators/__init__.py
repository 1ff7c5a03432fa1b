"""Relational operators over cells, requests, fields and logs."""
