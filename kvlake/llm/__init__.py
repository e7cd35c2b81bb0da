"""Training-data operators; nothing else in kvlake imports this subpackage."""
