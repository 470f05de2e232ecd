"""Readers: agent logs, session index, price file, file manifest, stored tables."""
