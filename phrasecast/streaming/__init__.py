"""Row-wise steps over a stream of files."""
