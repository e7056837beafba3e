"""plainframe plans."""
