"""See the README for the list of what lives here."""
