"""Where series come from and go to."""
