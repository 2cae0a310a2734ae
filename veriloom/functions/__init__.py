"""Building blocks the operators share."""
