"""Where rasters come from and where they are kept."""
