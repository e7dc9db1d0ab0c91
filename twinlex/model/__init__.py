"""A translation network: its layers, its training, and its use."""
