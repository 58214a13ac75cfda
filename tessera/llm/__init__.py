"""Operators that a training-data pipeline needs; nothing else imports this subpackage."""
