"""functions of the dossier package."""
