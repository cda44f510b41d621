"""Reading trip tables and writing result tables."""
