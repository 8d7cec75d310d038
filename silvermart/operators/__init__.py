"""Data operators that several plans share."""
