"""Functions of columns: text, identifiers, geometry, formats and validators."""
