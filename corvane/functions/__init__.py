"""Column functions of the catalog."""
