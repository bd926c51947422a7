"""Operators on series: features, spectra, analysis records, kernels, guards, mastering, stems."""
