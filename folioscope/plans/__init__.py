"""Plan helpers (skew, bounds) and the catalogue of runnable queries."""
