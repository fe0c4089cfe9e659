"""Writers: point datasets, features and markers."""
