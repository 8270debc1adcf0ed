"""Registered queries, their SQL counterparts and the check that compares both."""
