"""Operators for training corpora: one module each, with their queries in ``queries``."""
