"""Readers and writers: wide field sheets, weather station files, lookups, panels."""
