"""Where instances come from and where results go."""
