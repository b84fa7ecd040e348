"""Operators for preparing training text: documents and conversations in, decisions and counts out."""
