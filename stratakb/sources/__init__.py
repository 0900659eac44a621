"""sources of stratakb."""
