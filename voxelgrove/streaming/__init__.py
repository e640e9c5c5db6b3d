"""Slices that arrive over time: the same histograms, kept up to date."""
