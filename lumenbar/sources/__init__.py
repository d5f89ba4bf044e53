"""Readers, payload decoders and sinks."""
