"""Tables on disk: versions, manifests, CSV files."""
