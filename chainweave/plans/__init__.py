"""Configuration, the mention proxy over the driver's tables, and the registered queries."""
