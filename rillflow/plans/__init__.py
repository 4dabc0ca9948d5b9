"""Plans that put operators together: batch run, reader, query catalogue."""
