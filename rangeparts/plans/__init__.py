"""Plans: what to create, to clean up, and to complain about, as DataFrames."""
