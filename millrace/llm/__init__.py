"""Operators for preparing training text: scoring, tokens, near copies, leaks, personal data, markup."""
