"""State tracking and learned models."""
