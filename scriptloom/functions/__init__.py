"""Column functions: dictionary conversion, normalisation, segmentation."""
