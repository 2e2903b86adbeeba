"""How candidates of a similarity join are found without looking at every pair."""
