"""Writers: append per batch, keyed upsert tables."""
