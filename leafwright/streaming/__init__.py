"""Page packages as streams."""
