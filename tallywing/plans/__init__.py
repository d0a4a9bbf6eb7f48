"""Whole jobs: from sheets to panel, from panel to models, and the queries checked against SQL."""
