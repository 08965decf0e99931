"""DataFrame operators over the bar table."""
