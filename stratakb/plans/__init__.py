"""plans of stratakb."""
