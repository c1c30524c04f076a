"""Arriving repertoires: running profiles of a folder to which samples are added."""
