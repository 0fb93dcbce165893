"""Analytical marts, read views and batch refreshes composed from the operators."""
