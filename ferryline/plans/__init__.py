"""Job descriptions and the registered queries."""
