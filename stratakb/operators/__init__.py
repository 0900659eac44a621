"""operators of stratakb."""
