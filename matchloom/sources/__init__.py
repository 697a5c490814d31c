"""Readers and writers of the edges: JSON folders, XML lists, binary attachments, guarded and keyed tables."""
