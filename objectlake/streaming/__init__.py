"""streaming of objectlake."""
