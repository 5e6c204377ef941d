"""Part of veriloom."""
