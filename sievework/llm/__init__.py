"""Operators of a training-data pipeline: packing, sharding, sketches, line
dedup, pseudonyms, language ID, subword codecs, nearest neighbours, token files
and similarity joins.  Nothing outside this folder imports it."""
