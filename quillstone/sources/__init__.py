"""Page sources and the stored index."""
