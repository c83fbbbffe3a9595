"""Query registry over the driver tables."""
