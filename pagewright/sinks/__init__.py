"""Writers of document texts."""
