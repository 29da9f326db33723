"""streaming of the dossier package."""
