"""Plans that put several jobs together, and the registry of queries."""
