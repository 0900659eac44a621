"""queries of stratakb."""
