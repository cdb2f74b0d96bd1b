"""Plans: roles, candidates, rules, gates, and the runs that put operators together."""
