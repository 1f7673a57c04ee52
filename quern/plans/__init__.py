"""Ready-made query plans."""
