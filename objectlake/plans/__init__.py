"""plans of objectlake."""
