"""Readers of container formats and configuration, and the writers beside them."""
