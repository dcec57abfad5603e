"""Functions of the engine, as DataFrame expressions."""
