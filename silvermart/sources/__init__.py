"""Reading the feeds and writing the layers."""
