"""Operators of a training-data pipeline over `documents`-like tables; nothing else in quern imports this package."""
