"""Session set-up, shared scratch space and the query registry."""
