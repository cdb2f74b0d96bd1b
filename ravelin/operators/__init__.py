"""Set operators: profiles, exact checks, recall, facts, cards, retrieval, graphs."""
