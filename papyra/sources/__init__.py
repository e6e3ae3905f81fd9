"""Where documents come from and how the library keeps them."""
