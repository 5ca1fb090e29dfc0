"""functions of objectlake."""
