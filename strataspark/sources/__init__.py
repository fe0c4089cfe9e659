"""Readers: SQLite folders, rule files, GeoJSON layers, images."""
