"""Operators that prepare training text; nothing else in granary imports them."""
