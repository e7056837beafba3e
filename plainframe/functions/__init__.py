"""plainframe functions."""
