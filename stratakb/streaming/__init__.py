"""streaming of stratakb."""
