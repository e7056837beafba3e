"""plainframe sources."""
