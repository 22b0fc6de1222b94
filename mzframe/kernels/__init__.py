"""Bytes that no built-in function makes: CBOR documents and compressed arrays. Used inside Arrow UDFs."""
