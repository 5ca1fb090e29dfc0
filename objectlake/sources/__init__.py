"""sources of objectlake."""
