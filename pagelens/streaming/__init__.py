"""Pages and snapshots as they come."""
