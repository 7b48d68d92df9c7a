"""Streams: incremental linkage, and event windows. These add to the batch operators; nothing is reproduced here."""
