"""DataFrame-to-DataFrame operators over ordered series."""
