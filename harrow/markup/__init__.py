"""A tolerant document tree with selectors, and what is read from it."""
