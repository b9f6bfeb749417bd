"""Logical plans: the record log and what is read from it."""
