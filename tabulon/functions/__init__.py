"""Part of tabulon."""
