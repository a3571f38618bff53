"""Writers of rendered books."""
