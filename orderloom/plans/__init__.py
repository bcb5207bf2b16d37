"""Session settings, the refresh job and the query registry."""
