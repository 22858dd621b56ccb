"""Readers and writers of the file formats that matrices, ledgers and probes come in."""
