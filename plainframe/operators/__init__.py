"""plainframe operators."""
