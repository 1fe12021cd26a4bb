"""The change log and the snapshot, kept up to date from streams of files."""
