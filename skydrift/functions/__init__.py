"""Part of skydrift; see README.md."""
