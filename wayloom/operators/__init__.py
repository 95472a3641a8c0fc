"""DataFrame operators over the road graph."""
