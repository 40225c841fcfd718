"""Movements read from screen captures: layout, text, dates, votes between readings, and overlapping images."""
