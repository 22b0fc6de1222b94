"""Readers and writers of spectra."""
