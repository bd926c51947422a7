"""Rules, validation and the registered queries."""
