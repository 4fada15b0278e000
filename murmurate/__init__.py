"""Review analytics on Spark: versioned captures, claims, rollups, changes, search and exports."""
