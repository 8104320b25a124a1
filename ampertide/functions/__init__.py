"""Part of ampertide."""
