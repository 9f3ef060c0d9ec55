"""Where pages, truth and settings come from, and where results go."""
