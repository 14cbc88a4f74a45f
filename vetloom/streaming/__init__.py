"""Status events and continuous analysis."""
