"""Products: named band-math projections with display and validity ranges."""
