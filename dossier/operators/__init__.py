"""operators of the dossier package."""
