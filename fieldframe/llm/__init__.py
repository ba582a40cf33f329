"""Operators for preparing training data, each by its own method; nothing else imports this package."""
