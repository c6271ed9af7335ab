"""capweave.functions."""
