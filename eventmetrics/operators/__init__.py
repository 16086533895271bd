"""Analytics operators over events and config tables."""
