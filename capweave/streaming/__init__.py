"""capweave.streaming."""
