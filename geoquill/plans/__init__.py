"""From pipeline text to column expressions."""
