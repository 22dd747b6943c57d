"""Column functions, all native expressions but for the Unicode composition in ``text``."""
