"""Operators for preparing training text, their queries and SQL; nothing else in the package imports this one."""
