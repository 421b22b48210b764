"""Part of loomspan; see the README for what lives here."""
