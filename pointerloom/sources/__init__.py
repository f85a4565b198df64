"""Readers of log files, the source catalogue and the table writer."""
