"""Streams: counterparts of the snapshot folds for events that keep arriving."""
