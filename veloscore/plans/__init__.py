"""Jobs (J1-J4), sinks (K1, K2, A1) and the registered query catalog."""
