"""End-to-end plans of the flight domain, composed from the generic operators."""
