"""Fixture views, the rule catalogue and the registered queries."""
