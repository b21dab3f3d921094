"""The window job on a live log folder."""
