"""millrace: byte-stream codecs, transforms and corpus preparation as Spark DataFrame operators."""
