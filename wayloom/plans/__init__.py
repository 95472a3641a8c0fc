"""Registered queries, their derived inputs and their SQL."""
