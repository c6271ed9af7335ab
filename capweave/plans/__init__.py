"""capweave.plans."""
