"""Rule packs, run modes and the command line."""
