"""Part of scriptloom."""
