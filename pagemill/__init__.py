"""A PySpark engine for document-OCR data: sources, rasters, regions, decoding, assembly, evaluation and curation."""
