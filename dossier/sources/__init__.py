"""sources of the dossier package."""
