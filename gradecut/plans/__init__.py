"""Views that give general tables the shapes the operators expect, and the registered queries."""
