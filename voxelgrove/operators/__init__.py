"""Operators on voxel tables: masks, stencils, histograms, labels, mixtures, solvers, exports."""
