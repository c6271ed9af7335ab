"""capweave.sources."""
