"""Slices that arrive while a microscope is still writing."""
