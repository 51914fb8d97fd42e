"""Feature plans and the registered queries."""
