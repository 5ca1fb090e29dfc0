"""operators of objectlake."""
