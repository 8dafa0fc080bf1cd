"""Readers and writers of record text, binary frames and containers."""
