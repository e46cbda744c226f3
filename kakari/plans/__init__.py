"""From layers wanted to stages, and the registered queries with their SQL."""
