"""Department packs and the query catalog."""
