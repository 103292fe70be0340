"""lakekeep: file-tree and partitioned-table housekeeping as DataFrame jobs."""
