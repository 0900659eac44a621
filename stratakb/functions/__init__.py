"""functions of stratakb."""
