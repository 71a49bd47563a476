"""Files, raw blobs, log parsers and exports."""
