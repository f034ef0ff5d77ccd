"""Files in, files out: table readers, log and stream-frame readers, snapshots with an atomic pointer."""
