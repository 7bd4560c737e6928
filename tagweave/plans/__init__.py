"""Whole plans: sessions, test views, page graphs, the full run, and the registered queries."""
