"""Readers, generators and writers of media relations.  Parquet is the container of pictures and samples."""
