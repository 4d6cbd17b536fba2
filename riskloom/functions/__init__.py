"""Links, families and special functions."""
