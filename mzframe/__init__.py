"""mzframe: mass-spectrometry spectra, peaks and tokens as Spark DataFrames."""
