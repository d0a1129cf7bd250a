"""Readers: image folders, NPY volumes, spec texts, reconstruction results, run histories, test tables."""
