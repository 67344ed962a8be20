"""Part of skein."""
