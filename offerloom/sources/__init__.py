"""Readers and writers; every path may be on a shared file system."""
