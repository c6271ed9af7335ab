"""capweave.operators."""
