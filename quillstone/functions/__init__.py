"""Part of the quillstone engine; see the README for the map of modules."""
