"""Operators for preparing text corpora: one module per operator, plus their registered queries in ``queries``."""
