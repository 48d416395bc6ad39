"""Readers of pages and adapters that view tables as pages."""
