"""Readers and writers of the file formats that the engine exchanges."""
